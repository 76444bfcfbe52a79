"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points. Each level names its symbols, folds runs of equal symbols into one, and cuts the
sequence into phrases of two to about eight symbols where a label is largest among its neighbours. The labels come from
deterministic coin tossing: the lowest bit in which a symbol differs from the one before it, and that bit's value, taken
over again until few labels are left. A cut so depends on a few neighbours only, and a phrase's name on nothing but its
content: equal substrings get the same phrases inside, wherever they stand. Phrases are the symbols of the next level,
up to one name for the whole text.

The fingerprint holds the root name and the smallest hashes of the set of all phrase names from ``FIRST_LEVEL`` up;
likeness is the Jaccard estimate of two such samples. All texts of an Arrow batch are parsed together in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm.common import keyed_texts, table

SAMPLE = 128
FIRST_LEVEL = 2
BUCKET_ROWS = 4_000
MOST_CHARS = 4_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _toss_table(size: int) -> np.ndarray:
    """Next label for (label before, label): twice the lowest differing bit, plus its value."""
    a, b = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    differ = a ^ b
    low = np.bitwise_count((differ & -differ) - 1)
    low[differ == 0] = 0
    return (2 * low + ((b >> low) & 1)).astype(np.uint8).ravel()


_TOSS_128 = _toss_table(128)
_TOSS_16 = _toss_table(16)
_TOSS_8 = _toss_table(8)


def _cuts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases start. Neighbours within a text differ; ``first`` marks the first symbol of each text."""
    before = np.empty_like(names)
    before[0] = 0
    before[1:] = names[:-1]
    before[first] = names[first] ^ np.uint64(1)
    differ = names ^ before
    low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    label = ((low << np.uint64(1)) | ((names >> low) & np.uint64(1))).astype(np.uint8)
    at = np.flatnonzero(first)
    for toss, size in ((_TOSS_128, 128), (_TOSS_16, 16), (_TOSS_8, 8)):
        prior = np.empty(len(label), dtype=np.uint16)
        prior[0] = 0
        prior[1:] = label[:-1]
        prior[at] = label[at] ^ 1
        label = toss[prior * np.uint16(size) + label]
    # Below the labels of both neighbours' sides: a strict local maximum; missing neighbours count as lowest.
    left = np.zeros(len(label), dtype=np.uint8)
    right = np.zeros(len(label), dtype=np.uint8)
    lifted = label + 1
    left[1:] = lifted[:-1]
    left[at] = 0
    right[:-1] = lifted[1:]
    right[at[1:] - 1] = 0
    start = (lifted > left) & (lifted > right)
    # A symbol alone before the first cut, or after the last, joins its neighbour phrase.
    start[at] = True
    second = at + 1
    second = second[second < len(start)]
    second = second[~first[second]]
    start[second] = False
    return start


def parse(texts: Sequence[str]) -> list[tuple[int, np.ndarray]]:
    """Of each text: its root name, and the set of names of all phrases from ``FIRST_LEVEL`` up (sorted)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not len(texts):
        return []
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    names = mix(points.astype(np.uint64) + np.uint64(1))
    root = np.zeros(len(texts), dtype=np.uint64)
    found_doc: list[np.ndarray] = []
    found: list[np.ndarray] = []
    level = 0
    while len(names):
        # Runs of one symbol become one symbol, so neighbours differ.
        fresh = np.empty(len(names), dtype=bool)
        fresh[0] = True
        fresh[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(fresh)
        long = np.diff(np.append(at, len(names)))
        names, doc = names[at], doc[at]
        runs = long > 1
        names[runs] = mix(names[runs] + _STEP * long[runs].astype(np.uint64))
        first = np.empty(len(names), dtype=bool)
        first[0] = True
        first[1:] = doc[1:] != doc[:-1]
        if level >= FIRST_LEVEL:
            found.append(names)
            found_doc.append(doc)
        heads = np.flatnonzero(first)
        alone = np.diff(np.append(heads, len(names))) == 1
        done = heads[alone]
        root[doc[done]] = names[done]
        if level < FIRST_LEVEL:
            # A text that ends before the first counted level counts with its root.
            found.append(names[done])
            found_doc.append(doc[done])
        if alone.all():
            break
        going = np.ones(len(names), dtype=bool)
        going[done] = False
        names, doc, first = names[going], doc[going], first[going]
        start = np.flatnonzero(_cuts(names, first))
        place = (np.arange(len(names)) - np.repeat(start, np.diff(np.append(start, len(names))))).astype(np.uint64)
        names = mix(np.add.reduceat(mix(names + _STEP * (place + np.uint64(1))), start) + np.uint64(level))
        doc = doc[start]
        level += 1
    all_names, all_docs = (np.concatenate(found), np.concatenate(found_doc)) if found else (root[:0], doc[:0])
    order = np.lexsort((all_names, all_docs))
    all_names, all_docs = all_names[order], all_docs[order]
    ends = np.searchsorted(all_docs, np.arange(len(texts) + 1))
    return [(int(root[i]), np.unique(all_names[ends[i] : ends[i + 1]])) for i in range(len(texts))]


def sample_of(root: int, names: np.ndarray) -> np.ndarray:
    """The smallest hashes of the names; as a name is a hash already, the smallest names."""
    return names[:SAMPLE]


def as_text(root: int, names: np.ndarray) -> str:
    """Root name and sample as hex: ``root:name,name,...``; equal texts give equal fingerprints."""
    return f"{root:016x}:" + ",".join(f"{n:016x}" for n in sample_of(root, names).tolist())


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Jaccard estimate from the smallest names of the union; 1 for two empty texts, 0 if only one is empty."""
    x, y = sample_of(*a), sample_of(*b)
    if not len(x) and not len(y):
        return 1.0
    union = np.union1d(x, y)
    if len(x) == SAMPLE or len(y) == SAMPLE:
        union = union[:SAMPLE]
    common = np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True)
    return len(common) / len(union)


def fingerprint_texts(df: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars`` (code points), ``fingerprint`` of every row of ``df`` (doc_id, text). Null is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = [as_text(*p) for p in parse(batch["text"].tolist())]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_chars": batch["text"].str.len(), "fingerprint": marks})

    return keyed_texts(df).mapInPandas(run, "doc_id bigint, n_chars bigint, fingerprint string")


def in_order(df: DataFrame) -> DataFrame:
    """The texts in ascending (doc_id, text hash), dealt into buckets of about ``BUCKET_ROWS`` rows, with ``head``: the
    first row of each bucket comes a second time, at the end of the bucket before it (of the last, for the first).

    Bucket bounds are quantiles of a number that rises with (doc_id, hash), so a hot id is spread by its texts; ids that
    are null come first. The driver gets bounds and one row per bucket, both many thousand times fewer than the rows."""
    docs = keyed_texts(df).withColumn("hash", F.xxhash64("text"))
    part = F.pmod("hash", F.lit(1 << 20))
    place = F.when(F.col("doc_id").isNull(), F.lit(-(1 << 52)) + part).otherwise(F.col("doc_id") + part / F.lit(float(1 << 20))).cast("double")
    docs = docs.withColumn("place", place)
    rows = df.count()
    n = max(1, -(-rows // BUCKET_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    bounds = docs.approxQuantile("place", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = sorted(set(bounds))
    bucket = F.lit(0)
    if bounds:
        # Number of bounds at or below the place, by bisection in the executors.
        held = F.array(*map(F.lit, bounds))
        state = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

        def halve(s, _):
            middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
            right = (s["low"] < s["high"]) & (F.get(held, middle) <= F.col("place"))
            left = (s["low"] < s["high"]) & (F.get(held, middle) > F.col("place"))
            return F.struct(
                F.when(right, middle + 1).otherwise(s["low"]).alias("low"), F.when(left, middle).otherwise(s["high"]).alias("high")
            )

        steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
        bucket = F.aggregate(steps, state, halve, lambda s: s["low"])
    docs = docs.withColumn("bucket", bucket.cast("int"))
    heads = docs.groupBy("bucket").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("d"), F.col("hash").alias("h"))).alias("first")).collect()
    heads = sorted((r["bucket"], r["first"]["d"], r["first"]["h"]) for r in heads)
    goes_to = {b: (heads[i - 1][0], d, h) for i, (b, d, h) in enumerate(heads)}
    if not goes_to:
        return docs.withColumn("head", F.lit(False)).select("bucket", "head", "doc_id", "hash", "text")
    told = F.broadcast(
        df.sparkSession.createDataFrame([(b, *g) for b, g in goes_to.items()], "bucket int, prior int, first_id bigint, first_hash bigint")
    )
    is_first = (F.coalesce("doc_id", F.lit(-(1 << 62))) == F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    own = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("head"))
    copy = F.struct(F.col("prior").alias("to"), F.lit(True).alias("head"))
    dealt = docs.join(told, "bucket").withColumn("where", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))))
    out = dealt.select(F.col("where.to").alias("bucket"), F.col("where.head").alias("head"), "doc_id", "hash", "text")
    return out.repartition(len(goes_to), "bucket").sortWithinPartitions("bucket", "head", F.col("doc_id").asc_nulls_first(), "hash")


def compare_with_next(df: DataFrame) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next text in
    ascending doc_id (null ids first, equal ids by text hash; after the last comes the first). A single document is its
    own next one. Null texts are empty; an empty text's fingerprint has no names. Repeated rows keep their own rows.
    Other columns are ignored. A task holds one batch and the row before it; no bucket is gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: tuple[int, bool, int | None, str] | None = None

        def judged(pairs: list[tuple[int | None, str, str]]) -> pd.DataFrame:
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in pairs]
            # A text is the next one of the row before it, so most are needed twice and parsed once.
            place: dict[str, int] = {}
            for t in (x for (_, text, following), e in zip(pairs, edited, strict=True) for x in (text, e, following)):
                place.setdefault(t, len(place))
            parsed, rows = parse(list(place)), []
            for i, (doc_id, text, following_text) in enumerate(pairs):
                me, other, following = (parsed[place[t]] for t in (text, edited[i], following_text))
                digest = hashlib.sha256(edited[i].encode("utf-8")).hexdigest()
                rows.append((doc_id, len(text), digest, as_text(*me), as_text(*other), likeness(me, other), likeness(me, following)))
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

        for batch in batches:
            pairs: list[tuple[int | None, str, str]] = []
            chars = 0
            for bucket, head, doc_id, text in zip(batch["bucket"], batch["head"], batch["doc_id"], batch["text"], strict=True):
                if waiting is not None and waiting[0] == bucket and not waiting[1]:
                    pairs.append((waiting[2], waiting[3], text))
                    chars += 3 * len(waiting[3])
                    if chars > MOST_CHARS:
                        yield judged(pairs)
                        pairs, chars = [], 0
                waiting = (bucket, head, None if pd.isna(doc_id) else int(doc_id), text)
            if pairs:
                yield judged(pairs)

    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return in_order(df).select("bucket", "head", "doc_id", "text").mapInPandas(run, schema)


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compare_with_next(table(spark, folder, "documents"))
