"""Near-duplicate classes by ProbMinHash.

A text is a weighted set of five-word shingles (weight: how often it occurs). ProbMinHash lets every shingle arrive at
random components of the signature at the times of a Poisson process whose rate is its weight, and stops once the next
arrival is later than all components; two texts agree in a component with the probability Jaccard similarity. Bands of
components are the buckets of candidates; candidates are verified on their whole texts by the exact probability
Jaccard. Equal texts are one node from the start, so copies cost nothing.

Nothing lists the pairs of a bucket. First its members are compared with its leader, the one that meets most others in all
its buckets: of a family of copies the one nearest to all. Most buckets are then one component and done. A bucket that still
holds several is cut into chunks; a task gets two chunks, compares across components by signature and, where that is not far
below the threshold, by text, and returns no more links than unite the components. So every candidate pair ends in one class
or has been found below the threshold, and what is sent and returned grows with the members, not with their pairs."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.llm.common import table, whole_text
from inkfold.session import checkpointed, scratch_path

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 8
# Pairs whose signatures agree in a share this far below the threshold are not compared by text: more than five standard
# deviations of the estimate from 320 components.
MARGIN = 0.12
# Members of a chunk of a bucket, on average, and rows of a task of narrow tables, at least.
CHUNK = 512
NARROW_ROWS = 20_000
_WORD = re.compile(r"\w+")
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight) of all texts, sorted. A text of fewer words has one shingle of all of them;
    one without words has none. Words are runs of letters, digits and ``_``, lower-cased."""
    tokens = [_WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    flat = np.array([w for t in tokens for w in t], dtype=object)
    hashed = pd.util.hash_array(flat)
    doc = np.repeat(np.arange(len(tokens)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rest = np.repeat(sizes, sizes) - place
    total = np.zeros(len(flat), dtype=np.uint64)
    for k in range(words):
        moved = mix(hashed + np.uint64((int(_STEP) * (k + 1)) % (1 << 64)))
        end = max(len(flat) - k, 0)
        total[:end] += np.where(rest[:end] > k, moved[k:], np.uint64(0))
    starts = (rest >= words) | ((place == 0) & (rest < words))
    doc, names = doc[starts], mix(total[starts])
    order = np.lexsort((names, doc))
    doc, names = doc[order], names[order]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (names[1:] != names[:-1])])
    at = np.flatnonzero(fresh)
    return doc[at], names[at], np.diff(np.append(at, len(doc))).astype(float)


def prob_minhash(doc: np.ndarray, names: np.ndarray, weights: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Signatures (texts x size): per component the shingle that arrives first. Shingles whose next arrival is later
    than every component of their text are done."""
    best = np.full(texts * size, np.inf)
    who = np.zeros(texts * size, dtype=np.uint64)
    at = np.zeros(len(doc))
    step = 0
    while len(doc):
        step += 1
        random = mix(names + np.uint64((int(_STEP) * step) % (1 << 64)))
        at = at - np.log(((random >> np.uint64(11)).astype(float) + 0.5) / 9007199254740992.0) / weights
        slot = doc * size + (mix(random ^ _STEP) % np.uint64(size)).astype(np.int64)
        early = np.flatnonzero(at < best[slot])
        np.minimum.at(best, slot[early], at[early])
        won = early[at[early] == best[slot[early]]]
        who[slot[won]] = names[won]
        latest = best.reshape(texts, size).max(axis=1)
        going = at < latest[doc]
        doc, names, weights, at = doc[going], names[going], weights[going], at[going]
    return who.reshape(texts, size)


def signed_texts(texts, bands: int, rows: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Per text its band keys (none for a text without words) and the low bytes of its signature."""
    doc, names, weights = shingle_sets(texts)
    signature = prob_minhash(doc, names, weights, len(texts), bands * rows)
    parts = signature.reshape(len(texts), bands, rows)
    place = np.arange(rows, dtype=np.uint64) + np.uint64(1)
    keys = mix(mix(parts + _STEP * place).sum(axis=2) + _STEP * np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)
    some = np.zeros(len(texts), dtype=bool)
    some[doc] = True
    low = mix(signature).astype(np.uint8)
    return [keys[i] if some[i] else keys[i, :0] for i in range(len(texts))], [low[i].tobytes() for i in range(len(texts))]


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets (sorted hashes, weights): the sum over common elements i of
    1 / sum over k of max(a_k / a_i, b_k / b_i); with equal weights the Jaccard similarity."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[1][i], b[1][j]
    a_only, b_only = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    first = np.searchsorted(ratio, ratio, side="left")
    below_y = np.concatenate([[0.0], np.cumsum(y)])[first]
    above_x = x.sum() - np.concatenate([[0.0], np.cumsum(x)])[first]
    return float((x / (a_only + above_x + ratio * (b_only + below_y))).sum())


def node_of(text: Column) -> Column:
    """128-bit key of a text: equal texts are one node."""
    return F.unhex(F.md5(text))


def pinned(df: DataFrame) -> DataFrame:
    """Checkpoint of a narrow table (keys and ids only) that passes through many short rounds, in as few partitions as
    its rows need: each round writes a file per task and exchange, however little is in it.

    Also what is used twice is pinned: the driver holds the hash tables of all broadcasts of a running plan, and a plan
    repeats whatever is used twice in it."""
    kept = checkpointed(df)
    return kept.coalesce(max(2, -(-kept.count() // NARROW_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` of every node of ``edges`` (a, b): the smallest node it is connected with.

    Large-star and small-star rounds: each moves edges to smaller nodes until every component is a star. All state
    stays in checkpointed tables; a hot node is a key of a join with one row on the other side."""
    now = pinned(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = pinned(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = pinned(least.select("a", F.col("m").alias("b")).union(small).where("a <> b").distinct())
        # Stars: a node with a smaller one has no other, and is not the smaller one of another.
        ends = now.select("a", F.lit(1).alias("own"), F.lit(0).alias("root"))
        ends = ends.union(now.select("b", F.lit(0), F.lit(1)))
        tangled = ends.groupBy("a").agg((F.sum("own") + F.max("root")).alias("n")).where("n > 1")
        if tangled.isEmpty():
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class _Links:
    """Verified links among nodes, and their components so far. ``nodes``: node, low (bytes of the signature); ``texts``: node, text."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, similarity: float, bands: int):
        self.nodes, self.texts, self.similarity, self.bands = nodes, texts, similarity, bands
        self.roots: DataFrame | None = None

    def root_of(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        if self.roots is None:
            return rows.withColumn(name, F.col(column))
        known = self.roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        joined = rows.join(known, rows[column] == F.col("_n"), "left")
        return joined.withColumn(name, F.coalesce("_r", column)).drop("_n", "_r")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose nodes are in different components."""
        both = self.root_of(self.root_of(pairs, "a", "_ra"), "b", "_rb")
        return pinned(both.where("_ra <> _rb").drop("_ra", "_rb"))

    def verify(self, pairs: DataFrame) -> None:
        """Compare pairs (a, b), by signature and then by text; unite the components of those that are alike."""
        similarity = self.similarity

        def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    a, b = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("low_a", "low_b"))
                    yield batch.loc[(a == b).mean(axis=1) >= similarity - MARGIN, ["a", "b"]]

        low_a = self.nodes.select(F.col("node").alias("a"), F.col("low").alias("low_a"))
        low_b = self.nodes.select(F.col("node").alias("b"), F.col("low").alias("low_b"))
        pairs = pinned(pairs.join(low_a, "a").join(low_b, "b").select("a", "b", "low_a", "low_b").mapInPandas(likely, "a binary, b binary"))

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept: OrderedDict[bytes, tuple[np.ndarray, np.ndarray]] = OrderedDict()

            def shingles(node: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
                if node not in kept:
                    if len(kept) >= 500:
                        kept.popitem(last=False)
                    _, names, weights = shingle_sets([text])
                    kept[node] = (names, weights)
                kept.move_to_end(node)
                return kept[node]

            for batch in batches:
                good = [
                    probability_jaccard(shingles(bytes(a), ta), shingles(bytes(b), tb)) >= similarity
                    for a, b, ta, tb in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True)
                ]
                yield batch.loc[good, ["a", "b"]]

        text_a = self.texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        text_b = self.texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        full = pairs.join(text_a, "a").join(text_b, "b").select("a", "b", "text_a", "text_b").sortWithinPartitions("b")
        self.unite(full.mapInPandas(judge, "a binary, b binary"))

    def settle(self, rooms: DataFrame) -> None:
        """Compare all members of buckets (band, key, node, root) across components; unite those that are alike."""
        similarity, bands = self.similarity, self.bands

        def compare(chunks: pd.DataFrame) -> pd.DataFrame:
            links, band = [], int(chunks["band"].iloc[0])
            nodes = [bytes(n) for n in chunks["node"]]
            low = np.frombuffer(b"".join(chunks["low"]), np.uint8).reshape(len(nodes), -1)
            chunk = chunks["chunk"].to_numpy()
            within = (chunks["one"] == chunks["two"]).to_numpy()
            names: dict[bytes, int] = {}
            first = np.array([names.setdefault(bytes(r), len(names)) for r in chunks["root"]])
            parent = list(range(len(names)))
            sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def find(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            def shingles(i: int) -> tuple[np.ndarray, np.ndarray]:
                if i not in sets:
                    sets[i] = shingle_sets([chunks["text"].iat[i]])[1:]
                return sets[i]

            for i in range(len(nodes)):
                across = first[:i] != first[i]
                if not within[i]:
                    across &= chunk[:i] != chunk[i]
                others = np.flatnonzero(across)
                same = low[others] == low[i]
                close = same.mean(axis=1) >= similarity - MARGIN
                others, same = others[close], same[close]
                # A pair that shares several buckets is compared in the first of them.
                shared = same.reshape(len(others), bands, same.shape[1] // bands).all(axis=2)
                others = others[shared.argmax(axis=1) == band]
                for j in others.tolist():
                    x, y = find(first[i]), find(first[j])
                    if x != y and probability_jaccard(shingles(i), shingles(j)) >= similarity:
                        parent[x] = y
                        links.append((nodes[i], nodes[j]))
            return pd.DataFrame(links, columns=["a", "b"])

        sizes = rooms.groupBy("band", "key").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        placed = rooms.join(sizes, ["band", "key"]).join(self.nodes.select("node", "low"), "node").join(self.texts, "node")
        placed = placed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        pair = [F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two")]
        placed = placed.select("band", "key", *pair, "chunk", "node", "root", "low", "text")
        self.unite(placed.groupBy("band", "key", "one", "two").applyInPandas(compare, "a binary, b binary"))

    def unite(self, links: DataFrame) -> None:
        links = pinned(links)
        if links.isEmpty():
            return
        between = self.root_of(self.root_of(links, "a", "ra"), "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        moved = components(between)
        if self.roots is None:
            self.roots = pinned(moved)
            return
        step = moved.select(F.col("node").alias("root"), F.col("root").alias("_to"))
        old = self.roots.join(step, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
        fresh = moved.join(self.roots, "node", "left_anti")
        self.roots = pinned(old.unionByName(fresh))


def near_classes(df: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): class_id (smallest doc_id of the class), class_size (rows in it),
    text_id (smallest doc_id with this very text), kept (true for one row per class: the one with the smallest doc_id).

    Equal texts are always of one class, whatever their length: null and empty texts are one class, and so are texts
    that differ in case or punctuation only. Rows with a null id belong to classes as others do (class_id is null if
    all ids are). Of repeated rows with the smallest id one is kept. An empty table gives an empty result. Other columns
    are ignored."""
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).withColumn("node", node_of(F.col("text")))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, low = signed_texts(batch["text"].tolist(), bands, rows)
            yield batch[["node", "doc_id"]].assign(keys=keys, low=low)

    signed = docs.mapInPandas(sign, "node binary, doc_id bigint, keys array<bigint>, low binary")
    first = [F.min("doc_id").alias("text_id"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("low").alias("low")]
    nodes = checkpointed(signed.groupBy("node").agg(*first))
    placed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    sizes = placed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(placed.join(sizes, ["band", "key"]))
    # How often a node meets another one, over all its buckets.
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    leaders = shared.join(met, "node").groupBy("band", "key").agg(F.max(F.struct("met", "node"))["node"].alias("leader"))

    wanted = met.select("node").join(nodes.select("node", "text_id"), "node")
    keyed = docs.withColumn("text_id", F.coalesce("doc_id", F.lit(-(1 << 62))))
    filter_ = wanted.select("node", F.coalesce("text_id", F.lit(-(1 << 62))).alias("text_id"))
    path = scratch_path(spark, "near-texts")
    keyed.join(filter_, ["node", "text_id"]).select("node", "text").dropDuplicates(["node"]).write.parquet(path)

    links = _Links(nodes, spark.read.parquet(path), similarity, bands)
    led = shared.join(leaders, ["band", "key"]).where("node <> leader")
    pairs = pinned(led.groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("n")))
    # The leader that a node shares most buckets with, then the others that are still in another component.
    best = pairs.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    links.verify(best)
    links.verify(links.apart(pairs.join(best, ["a", "b"], "left_anti").select("a", "b")))
    # A bucket of two is settled: one of them led it.
    rooms = links.root_of(shared.where("n > 2").select("band", "key", "node"), "node", "root")
    mixed = rooms.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    links.settle(pinned(rooms.join(pinned(mixed.select("band", "key")), ["band", "key"])))

    rooted = links.root_of(nodes.select("node", "text_id", "copies"), "node", "root")
    # The row that stays has the smallest id; of several texts with that id, the smallest node.
    first = F.min(F.struct(F.coalesce("text_id", F.lit(1 << 62)).alias("id"), F.col("node").alias("node")))
    classes = rooted.groupBy("root").agg(F.min("text_id").alias("class_id"), F.sum("copies").alias("class_size"), first["node"].alias("head"))
    told = checkpointed(rooted.join(classes, "root").select("node", "text_id", "class_id", "class_size", "head"))
    out = docs.select("doc_id", "node").join(told, "node")
    is_head = (F.col("node") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    # Only rows of the head's text and id can be repeated heads; number those.
    heads = out.where(is_head).withColumn("nth", F.row_number().over(Window.partitionBy("node", "doc_id").orderBy("doc_id")))
    rest = out.where(~is_head)
    columns = ["doc_id", "text_id", "class_id", "class_size", "node"]
    return heads.select(*columns, (F.col("nth") == 1).alias("kept")).unionByName(rest.select(*columns, F.lit(False).alias("kept")))


def keep_one(df: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df``, with all their columns, that ``near_classes`` keeps: one per class, the one with the smallest
    doc_id. Of rows with equal id and text, one stays."""
    kept = near_classes(df, similarity).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node"))
    mine = df.select(
        F.struct(*[F.col(c) for c in df.columns]).alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        node_of(whole_text()).alias("node"),
    )
    same = (F.col("node") == F.col("kept_node")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    copy = F.row_number().over(Window.partitionBy("node", "doc_id").orderBy(F.xxhash64("row")))
    return mine.join(kept, same, "left_semi").withColumn("copy", copy).where("copy = 1").select("row.*")


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_classes(table(spark, folder, "documents")).drop("node")
