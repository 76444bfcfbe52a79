"""Exact BM25 top-k over an inverted index in shards, pruned by block maxima: a MaxScore split, without the pivots of WAND.

``build_index`` turns documents into one row per shard: term-major postings, and the same postings by document. Corpus
statistics (documents, mean length, document frequency of the query terms) are summed over all shards, so every shard
scores with the same numbers and the merged result equals one scan of everything. Inside a shard, documents that share
their frequent words stand together, by length, so that the largest impacts in a block of documents bound it well.

A shard is searched by groups of queries. The postings of the less frequent terms of the queries are read and summed.
The frequent terms are left out at first: a block's largest impacts plus the best sum in the block decide for each
query whether the block can reach the k-th best score so far, and only then the frequent terms are added, as a product of
matrices. That is done in single precision; what is not below the k-th score by more than its error is scored in full. The
k-th best score carries over from shard to shard of a task."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.llm.common import keyed_texts, prepare, table
from inkfold.session import checkpointed, scratch_path

K1, B = 1.2, 0.75
K = 10
SHARD_DOCS, SHARD_WORDS = 4096, 3_000_000
BLOCK = 64
# Queries searched per pass over the index; their terms are broadcast.
QUERY_BLOCK = 8192
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Terms in at least this share of a shard's documents are frequent, the most frequent so many at most.
FREQUENT, FREQUENT_TERMS = 1 / 20, 1024
# A sum of so many positive numbers in single precision is wrong by less than this share.
SLACK = 1e-4
# Queries searched together, and the postings read at a time, of so many queries at most.
GROUP, READ, READ_QUERIES = 256, 1 << 16, 16
# Groups of alike documents in a shard, told by so many of its terms.
ALIKE, ALIKE_TERMS = 8, 256
# Texts are cut into words by so many bytes, and a table has the codes of the bytes at the first places of a word.
CHUNK, PLACES = 1 << 18, 64


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits for each number."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes of UTF-8 belong to words, the bytes with A-Z lower-cased, and the code of each byte at each place."""
    byte = np.arange(256)
    upper = (byte >= 65) & (byte <= 90)
    word = (byte >= 128) | ((byte >= 48) & (byte <= 57)) | upper | ((byte >= 97) & (byte <= 122))
    return word, np.where(upper, byte + 32, byte), _mixed(np.arange(PLACES * 256))


def _cut_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    is_word, lower, codes = _bytes()
    inside = is_word[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    # A text begins a word of its own, whatever the text before ends with.
    first = at[:-1][at[:-1] < len(data)]
    begin[first] = inside[first]
    used = np.flatnonzero(inside)
    starts = np.flatnonzero(begin[used])
    sizes = np.diff(np.append(starts, len(used)))
    code = (np.arange(len(used)) - np.repeat(starts, sizes)) * 256 + lower[data[used]]
    value = codes[np.minimum(code, len(codes) - 1)]
    far = np.flatnonzero(code >= len(codes))
    value[far] = _mixed(code[far])
    hashes = np.add.reduceat(value, starts) if len(starts) else np.zeros(0, np.uint64)
    return hashes.view(np.int64), np.diff(np.searchsorted(used[starts], at))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, in order, and how many words each text has. The hash of a
    word is the sum of the codes of its bytes at their places."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    parts, i = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
        parts.append(_cut_words(data[at[i] : at[j]], at[i : j + 1] - at[i]))
        i = j
    return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])


def terms_of(text: str) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased, in order."""
    return words_of(pa.array([text], pa.large_string()))[0]


def _ranges(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of the given rows, and which row each belongs to."""
    size = at[rows + 1] - at[rows]
    end = np.cumsum(size)
    return np.arange(size.sum()) + np.repeat(at[rows] - end + size, size), np.repeat(np.arange(len(rows)), size)


def _pairs(posts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of packed postings."""
    return posts.view(np.int32)[::2], posts.view(np.float32)[1::2]


def _alike(doc: np.ndarray, term: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """An order of the documents: by the nearest of ``ALIKE`` unlike documents as far as frequent terms go, then by length."""
    n = len(lengths)
    told = term < ALIKE_TERMS
    has = np.zeros((n, ALIKE_TERMS), np.float32)
    has[doc[told], term[told]] = 1
    has /= np.maximum(np.sqrt(has.sum(axis=1, keepdims=True)), 1)
    near = has @ has.mean(axis=0)
    leader, group = int(np.argmax(near)) if n else 0, np.zeros(n, np.int64)
    near = has @ has[leader] if n else near
    for i in range(1, ALIKE):
        # The next leader is the one with the most frequent terms among those that are far from all others.
        far = np.where(near <= np.quantile(near, 0.05) + 1e-6, has.astype(bool).sum(axis=1), -1) if n else near
        to = has @ has[int(np.argmax(far))] if n else near
        group[to > near] = i
        near = np.maximum(near, to)
    return np.lexsort((lengths, group))


class Shard:
    """Postings of a shard by document (``doc_*``) and by term (``frequencies``, ``post_*``)."""

    # ``None`` is the smallest unsigned kind that holds the numbers.
    KINDS = {
        "ids": np.int64, "nulls": np.uint8, "lengths": np.int64, "terms": np.int64, "doc_at": np.int64, "doc_term": None,
        "doc_tf": None, "frequencies": None, "post_doc": None, "post_tf": None,
    }

    def __init__(self, **fields: np.ndarray):
        for name, kind in self.KINDS.items():
            values = fields[name]
            kind = kind or np.min_scalar_type(int(values.max(initial=0)))
            setattr(self, name, values.astype(kind, copy=False))
        self.term_at = np.concatenate([[0], np.cumsum(self.frequencies, dtype=np.int64)])

    @classmethod
    def build(cls, ids: pa.Array, texts: pa.Array) -> Shard:
        flat, lengths = words_of(texts)
        number, terms = pd.factorize(flat)
        n, m = len(lengths), max(len(terms), 1)
        # The terms with the most words come first: what many queries ask for stands together.
        order = np.argsort(-np.bincount(number, minlength=len(terms)), kind="stable")
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        pair, tf = np.unique(np.repeat(np.arange(n), lengths) * m + place[number], return_counts=True)
        doc, term = pair // m, pair % m
        moved = _alike(doc, term, lengths)
        now = np.empty(n, np.int64)
        now[moved] = np.arange(n)
        by_doc, _ = _ranges(np.searchsorted(doc, np.arange(n + 1)), moved)
        doc, term, tf = now[doc[by_doc]], term[by_doc], tf[by_doc]
        by_term = np.argsort(term, kind="stable")
        return cls(
            ids=ids.fill_null(0).to_numpy(zero_copy_only=False)[moved], nulls=ids.is_null().to_numpy(zero_copy_only=False)[moved],
            lengths=lengths[moved], terms=terms[order], doc_at=np.searchsorted(doc, np.arange(n + 1)), doc_term=term, doc_tf=tf,
            frequencies=np.bincount(term, minlength=len(terms)), post_doc=doc[by_term], post_tf=tf[by_term],
        )

    def pack(self) -> dict[str, bytes]:
        return {f: getattr(self, f).tobytes() for f in self.KINDS}

    @classmethod
    def unpack(cls, batch: pa.RecordBatch, row: int) -> Shard:
        data = {f: batch.column(f)[row].as_buffer() for f in cls.KINDS}
        count = {"terms": data["terms"].size // 8, "postings": int(np.frombuffer(data["doc_at"], np.int64)[-1])}
        kinds = {f: kind or cls._kind(data[f], count["terms" if f == "frequencies" else "postings"]) for f, kind in cls.KINDS.items()}
        shard = cls.__new__(cls)
        for f, kind in kinds.items():
            setattr(shard, f, np.frombuffer(data[f], dtype=kind))
        shard.term_at = np.concatenate([[0], np.cumsum(shard.frequencies, dtype=np.int64)])
        return shard

    @staticmethod
    def _kind(data: pa.Buffer, count: int) -> str:
        return f"u{data.size // max(count, 1) or 1}"

    def prepare(self, vocabulary: np.ndarray, idf: np.ndarray, mean_length: float) -> None:
        """Scores of the postings of the terms of ``vocabulary``, those of frequent terms as a matrix, and its block maxima."""
        n, m = len(self.ids), len(self.terms)
        at = np.searchsorted(vocabulary, self.terms)
        at[at == len(vocabulary)] = 0
        asked = np.flatnonzero(vocabulary[at] == self.terms) if len(vocabulary) else np.zeros(0, np.int64)
        self.row = np.full(len(vocabulary), -1, np.int32)
        self.row[at[asked]] = asked
        self.idf = np.zeros(m)
        self.idf[asked] = idf[at[asked]]
        self.norm = K1 * (1 - B + B * self.lengths / max(mean_length, 1e-9))
        size = np.diff(self.term_at)
        # A posting's document and score are one number of 64 bits, so that one access reads both.
        posts = np.empty((len(self.post_doc), 2), np.float32)
        tf = self.post_tf.astype(np.float32)
        gain = np.divide(tf, tf + self.norm.astype(np.float32)[self.post_doc], out=tf)
        gain *= np.repeat((self.idf * (K1 + 1)).astype(np.float32), size)
        posts[:, 1] = gain
        posts.view(np.int32)[:, 0] = self.post_doc
        self.posts = posts.view(np.int64).reshape(-1)
        frequent = asked[size[asked] >= max(1, FREQUENT * n)]
        frequent = frequent[np.argsort(-size[frequent], kind="stable")[:FREQUENT_TERMS]]
        self.frequent = np.full(m, -1, np.int32)
        self.frequent[frequent] = np.arange(len(frequent))
        self.blocks = -(-n // BLOCK)
        self.matrix = np.zeros((self.blocks, len(frequent), BLOCK), np.float32)
        entry, which = _ranges(self.term_at, frequent)
        doc, gain = _pairs(self.posts[entry])
        self.matrix[doc // BLOCK, which, doc % BLOCK] = gain
        self.largest = np.ascontiguousarray(self.matrix.max(axis=2, initial=0).T)

    def _read(self, query: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
        """Sums of the scores of the given terms, by query and block."""
        width = self.blocks * BLOCK
        out = np.zeros((count, width), np.float32)
        first, size = self.term_at[rows], self.term_at[rows + 1] - self.term_at[rows]
        end = np.cumsum(size)
        i = 0
        while i < len(rows):
            # Few at a time, so that they stay in the processor's cache.
            j = int(np.searchsorted(end, end[i] - size[i] + READ, side="right"))
            j = max(i + 1, min(j, int(np.searchsorted(query, query[i] + READ_QUERIES))))
            start, some = int(query[i]), int(query[j - 1] - query[i]) + 1
            entry = np.repeat(first[i:j] - end[i:j] + size[i:j], size[i:j])
            entry += np.arange(end[i] - size[i], end[j - 1])
            cell = np.repeat((query[i:j] - start) * width, size[i:j])
            doc, gain = _pairs(self.posts[entry])
            cell += doc
            out[start : start + some] += np.bincount(cell, weights=gain, minlength=some * width).reshape(some, width)
            i = j
        return out.reshape(count, self.blocks, BLOCK)

    def search(self, words: np.ndarray, at: np.ndarray, floor: np.ndarray, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, document numbers, scores) for the queries whose terms, as places in the vocabulary, are ``words[at[i]:at[i + 1]]``:
        the ``k`` best documents of this shard as far as they score at least ``floor``, and maybe others. ``floor`` 0 is no floor."""
        count = len(floor)
        query = np.repeat(np.arange(count), np.diff(at))
        rows = self.row[words[at[0] : at[-1]]]
        query, rows = query[rows >= 0], rows[rows >= 0]
        if not len(rows):
            return
        place = self.frequent[rows]
        often = place >= 0
        asked = np.zeros((count, len(self.largest)), np.float32)
        asked[query[often], place[often]] = 1
        sums = self._read(query[~often], rows[~often], count)
        # A little slack, so that rounding never drops a tie.
        need = np.maximum(floor * (1 - SLACK) - 1e-5, 0).astype(np.float32)
        free, least = np.flatnonzero(floor <= 0), np.where(floor > 0, np.maximum(need, np.finfo(np.float32).tiny), np.inf).astype(np.float32)
        reach = asked @ self.largest + sums.max(axis=2)
        reach = (reach > 0) & (reach >= need[:, None])
        found = []
        for block in np.flatnonzero(reach.any(axis=0)):
            some = np.flatnonzero(reach[:, block])
            score = asked[some] @ self.matrix[block] + sums[some, block]
            if len(free):
                sums[some, block] = score
            hit = np.flatnonzero(score >= least[some, None])
            if len(hit):
                found.append(np.stack([some[hit // BLOCK], block * BLOCK + hit % BLOCK]))
        if len(free):
            score = sums[free].reshape(len(free), -1)
            if score.shape[1] > k:
                # Only what can be among the best is scored anew.
                need = np.partition(score, -k, axis=1)[:, -k] * (1 - 2 * SLACK) - 2e-5
                hit = np.flatnonzero((score > 0) & (score >= need[:, None]))
            else:
                hit = np.flatnonzero(score > 0)
            found.append(np.stack([free[hit // score.shape[1]], hit % score.shape[1]]))
        if not found:
            return
        which, docs = np.concatenate(found, axis=1)
        order = np.argsort(which, kind="stable")
        which, docs = which[order], docs[order]
        for part in np.split(np.arange(len(which)), np.flatnonzero(np.diff(which)) + 1):
            if len(part):
                n = int(which[part[0]])
                own = rows[slice(*np.searchsorted(query, [n, n + 1]))]
                yield n, docs[part], self._score(own, docs[part])

    def _score(self, rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The rounded scores of documents in double precision, from all terms of the query."""
        rows = np.sort(rows).astype(self.doc_term.dtype)
        scores = np.zeros(len(docs))
        for i, d in enumerate(docs.tolist()):
            terms, tf = (x[self.doc_at[d] : self.doc_at[d + 1]] for x in (self.doc_term, self.doc_tf))
            # The shorter list is looked up in the longer one; both are sorted.
            few, many = (rows, terms) if len(rows) < len(terms) else (terms, rows)
            at = np.searchsorted(many, few)
            at[at == len(many)] = 0
            same = np.flatnonzero(many[at] == few)
            tf = tf[at[same] if few is rows else same].astype(np.float64)
            scores[i] = (self.idf[few[same]] * (tf * (K1 + 1) / (tf + self.norm[d]))).sum()
        return np.round(scores, 6)


INDEX_SCHEMA = "docs bigint, words bigint, " + ", ".join(f"{f} binary" for f in Shard.KINDS)


def build_index(df: DataFrame) -> DataFrame:
    """One row per shard of at most ``SHARD_DOCS`` documents or about ``SHARD_WORDS`` words. No shuffle: a shard is a run
    of rows of a partition. Null texts are empty documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        texts: list[pa.Array] = []
        docs = size = 0

        def packed() -> pa.RecordBatch:
            shard = Shard.build(pa.concat_arrays(ids), pa.concat_arrays(texts))
            row = {"docs": docs, "words": int(shard.lengths.sum()), **shard.pack()}
            return pa.RecordBatch.from_pydict({f: pa.array([v], pa.int64() if f in ("docs", "words") else pa.binary()) for f, v in row.items()})

        for batch in batches:
            keys, own = batch.column("doc_id"), batch.column("text").cast(pa.large_string())
            until = np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(own):
                before = int(until[start - 1]) if start else 0
                full = int(np.searchsorted(until, before + 6 * SHARD_WORDS - size)) + 1
                end = min(len(own), start + SHARD_DOCS - docs, max(full, start + 1))
                ids.append(keys.slice(start, end - start))
                texts.append(own.slice(start, end - start))
                docs, size, start = docs + end - start, size + int(until[end - 1]) - before, end
                if docs >= SHARD_DOCS or size >= 6 * SHARD_WORDS:
                    yield packed()
                    ids, texts, docs, size = [], [], 0, 0
        if docs:
            yield packed()

    return keyed_texts(df).mapInArrow(run, INDEX_SCHEMA)


def search(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id``, ``rank``, ``doc_id``, ``score`` (rounded to six places): the ``k`` best documents of every query
    (query_id, text) by BM25 over its distinct words; ties by doc_id, null last.

    A query without words, or whose words no document has, gives no rows; documents that share no word with a query are
    no results. Rows of equal query_id and text are one query. Queries go in blocks of ``QUERY_BLOCK``: their
    term lists are broadcast, so memory does not grow with the number of queries; work does, as each query has to meet
    each shard."""
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    count, mean = total[0], total[1] / max(total[0], 1)
    # One shard in so many, the root of their number, is searched first, for the score that the others have to reach.
    share = max(1, round(total[2] ** 0.5))
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def term_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["query_id"]].assign(terms=[np.unique(terms_of(t)) for t in batch["text"]])

    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id", "text"), F.lit(blocks)) == block)
        wanted = part.mapInPandas(term_lists, "query_id bigint, terms array<bigint>").toPandas()
        wanted = wanted[wanted.terms.str.len() > 0]
        lists = [np.asarray(t, dtype=np.int64) for t in wanted.terms]
        vocabulary, words = np.unique(np.concatenate([np.zeros(0, np.int64), *lists]), return_inverse=True)
        known = spark.sparkContext.broadcast({"vocabulary": vocabulary})

        def count_documents(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            vocabulary = known.value["vocabulary"]
            df = np.zeros(len(vocabulary), dtype=np.int64)
            for batch in batches:
                for i in range(len(batch)):
                    terms = np.frombuffer(batch.column("terms")[i].as_buffer(), np.int64)
                    size = batch.column("frequencies")[i].as_buffer()
                    size = np.frombuffer(size, Shard._kind(size, len(terms)))
                    at = np.searchsorted(vocabulary, terms)
                    at[at == len(vocabulary)] = 0
                    same = vocabulary[at] == terms if len(vocabulary) else np.zeros(len(at), bool)
                    df[at[same]] += size[same]
            seen = np.flatnonzero(df)
            for i in range(0, len(seen), 100_000):
                yield pa.RecordBatch.from_pydict({"term": vocabulary[seen[i : i + 100_000]], "df": df[seen[i : i + 100_000]]})

        counted = index.select("terms", "frequencies").mapInArrow(count_documents, "term bigint, df bigint")
        counted = counted.groupBy("term").agg(F.sum("df").alias("df")).toPandas()
        frequency = np.zeros(len(vocabulary))
        frequency[np.searchsorted(vocabulary, counted.term.to_numpy())] = counted.df.to_numpy()
        idf = np.log(1 + (count - frequency + 0.5) / (frequency + 0.5))
        ids = [None if pd.isna(q) else int(q) for q in wanted.query_id]
        at = np.concatenate([[0], np.cumsum([len(t) for t in lists], dtype=np.int64)])
        told = {"ids": ids, "words": words.astype(np.int32), "at": at, "vocabulary": vocabulary, "idf": idf}
        held = spark.sparkContext.broadcast({"queries": told})

        def find(batches: Iterator[pa.RecordBatch], held=held, floors=None) -> Iterator[pa.RecordBatch]:
            told = held.value["queries"]
            ids, words, at = told["ids"], told["words"], told["at"]
            least = floors.value["floors"].copy() if floors is not None else np.zeros(len(ids))
            best: list[list[tuple[float, bool, int]]] = [[] for _ in ids]

            def visit(shard: Shard) -> None:
                shard.prepare(told["vocabulary"], told["idf"], mean)
                for start in range(0, len(ids), GROUP):
                    end = min(start + GROUP, len(ids))
                    for n, docs, scores in shard.search(words, at[start : end + 1], least[start:end], k):
                        heap = best[start + n]
                        if len(docs) > k:
                            # Best first; ties by null id, then id.
                            top = np.lexsort((shard.ids[docs], shard.nulls[docs], -scores))[:k]
                            docs, scores = docs[top], scores[top]
                        for d, s in zip(docs.tolist(), scores.tolist(), strict=True):
                            entry = (s, not shard.nulls[d], -int(shard.ids[d]))
                            if len(heap) < k:
                                heapq.heappush(heap, entry)
                            elif entry > heap[0]:
                                heapq.heapreplace(heap, entry)
                        if len(heap) == k:
                            least[start + n] = max(least[start + n], heap[0][0])

            for batch in batches:
                for i in range(len(batch)):
                    visit(Shard.unpack(batch, i))
            rows = [(ids[n], n, -i if known else None, s) for n, heap in enumerate(best) for s, known, i in heap]
            for i in range(0, len(rows), 100_000):
                columns = list(zip(*rows[i : i + 100_000], strict=True))
                kinds = {"query_id": pa.int64(), "query": pa.int32(), "doc_id": pa.int64(), "score": pa.float64()}
                yield pa.RecordBatch.from_pydict({f: pa.array(c, t) for (f, t), c in zip(kinds.items(), columns, strict=True)})

        # The k-th best score in some of the shards is a floor for all: the others start from it.
        schema = "query_id bigint, query int, doc_id bigint, score double"
        some = F.pmod(F.xxhash64("ids"), F.lit(share)) == 0
        first = checkpointed(index.where(some).mapInArrow(find, schema))
        at_k = Window.partitionBy("query").orderBy(F.desc("score"))
        kth = first.withColumn("n", F.row_number().over(at_k)).where(F.col("n") == k).select("query", "score").toPandas()
        floors = np.zeros(len(ids))
        floors[kth["query"].to_numpy()] = kth["score"].to_numpy()
        shared = spark.sparkContext.broadcast({"floors": floors})
        others = index.where(~some).mapInArrow(lambda it, find=find, shared=shared: find(it, floors=shared), schema)
        local = first.unionByName(others)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        merged = local.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
        out = merged if out is None else out.unionByName(merged)
    return out


def op2_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every document whose id is divisible by 100, its whole text as the query, against all documents."""
    documents = table(prepare(spark), folder, "documents")
    path = scratch_path(spark, "bm25-index")
    build_index(documents).write.parquet(path)
    # A shard is a row of some megabytes: few to a batch.
    queries = documents.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search(spark.read.parquet(path), queries).withColumn("rank", F.col("rank").cast("bigint"))


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
tf AS (SELECT doc_id, any_value(len(w)) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
imp AS (
  SELECT doc_id, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) AS impact
  FROM tf JOIN df USING (term), n
), s AS (
  SELECT q.doc_id AS query_id, i.doc_id, round(sum(impact), 6) AS score
  FROM (SELECT doc_id, term FROM tf WHERE doc_id % 100 = 0) q JOIN imp i USING (term) GROUP BY q.doc_id, i.doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= {K}"""
