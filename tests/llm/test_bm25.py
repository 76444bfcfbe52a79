import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import inkfold.llm.bm25 as bm25
from check import connect, rows

WORD = re.compile(bm25.WORD)


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, queries, k=10):
    split = [words(t) for _, t in docs]
    n, mean = len(docs), sum(map(len, split)) / max(1, len(docs))
    tfs = [Counter(w) for w in split]
    df = Counter(t for tf in tfs for t in tf)
    out = set()
    for qid, text in set(queries):
        scored = []
        for (doc_id, _), tf, dl in zip(docs, tfs, map(len, split), strict=True):
            s = sum(
                math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * dl / mean))
                for t in set(words(text))
                if t in tf
            )
            if s > 0:
                scored.append((-round(s, 6), doc_id is None, doc_id or 0, doc_id))
        out |= {(qid, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])}
    return out


def found(spark, docs, queries, k=10):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS terms", "'x' AS ids").repartition(5)
    asked = spark.createDataFrame(queries, "query_id bigint, text string")
    index = bm25.build_index(df).cache()
    return {(r.query_id, r["rank"], r.doc_id, r.score) for r in bm25.search(index, asked, k).collect()}


def same(got, want):
    assert {x[:3] for x in got} == {x[:3] for x in want}
    scores = {x[:3]: x[3] for x in want}
    assert all(abs(s - scores[q, r, d]) < 2e-6 for q, r, d, s in got)


@pytest.mark.parametrize("shard", [7, 4096])
def test_equals_brute_force(spark, sf, monkeypatch, shard):
    monkeypatch.setattr(bm25, "SHARD_DOCS", shard)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    queries = [d for d in docs if d[0] % 20 == 0] + [(1, "the of and"), (2, "no such wordzzz"), (3, "")]
    same(found(spark, docs, queries), brute(docs, queries))


def test_nulls_ties_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 2)
    docs = [(i, "red green blue") for i in range(30)] + [(None, "red green blue"), (40, None), (41, ""), (42, "red " * 5000), (42, "RED")]
    queries = [(0, "red"), (0, "red"), (1, "Green zzz"), (5, None), (None, "blue red"), (7, "red green blue")]
    want = brute(docs, [q for q in queries if q[1]])
    same(found(spark, docs, queries), want)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bm25.search(bm25.build_index(empty), spark.createDataFrame([(1, "x")], "query_id bigint, text string")).count() == 0


def test_query_equals_sql(spark, sf):
    assert rows(bm25.op2_topk_search(spark, sf).toPandas()) == rows(connect(sf).execute(bm25.OP2_SQL).df())


def test_words_by_bytes():
    """Words and their equality by the bytes of all texts at once are those of the pattern, text by text."""
    texts = ["", "Aa aA-aa", "naïve Ünï", "x" * 300 + " " + "x" * 299 + "y " + "X" * 300, "end", "start", " a1 _1a\n", "😀é ß"] * 3
    hashes, lengths = bm25.words_of(pa.array(texts).slice(1))
    want = [w for t in texts[1:] for w in words(t)]
    assert lengths.tolist() == [len(words(t)) for t in texts[1:]]
    assert len(set(zip(hashes.tolist(), want, strict=True))) == len(set(hashes.tolist())) == len(set(want))


@pytest.mark.parametrize("floored", [False, True])
def test_frequent_terms_are_left_out(floored, monkeypatch):
    """Two languages of skewed words: a group of queries takes one pass over the shard, which reads a small part of the postings of
    their terms, blocks that cannot reach the floor are not scored, and the results are those of all pairs."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"{'ab'[i % 2]}{w}" for w in (rng.zipf(1.3, 60 + i % 200) % 5000)) for i in range(2000)]
    shard = bm25.Shard.build(pa.array(range(2000)), pa.array(texts))
    lists = [np.unique(bm25.terms_of(t)) for t in texts[::20]]
    vocabulary, places = np.unique(np.concatenate(lists), return_inverse=True)
    at = np.concatenate([[0], np.cumsum([len(t) for t in lists])])
    tfs = [Counter(words(t)) for t in texts]
    df, mean = Counter(t for tf in tfs for t in tf), sum(map(len, map(words, texts))) / 2000
    idf = {t: math.log(1 + (2000 - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    code = {int(bm25.terms_of(t)[0]): t for t in df}
    shard.prepare(vocabulary, np.array([idf[code[int(v)]] for v in vocabulary]), mean)
    gains = [{t: idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * tf.total() / mean)) for t, n in tf.items()} for tf in tfs]
    scores = [[sum(gains[d][t] for t in tfs[20 * q].keys() & gains[d].keys()) for d in range(2000)] for q in range(100)]
    tenth = np.sort(scores, axis=1)[:, -10]
    read = []
    inner = bm25.Shard._read
    monkeypatch.setattr(bm25.Shard, "_read", lambda self, query, rows, n: read.append(int(np.diff(self.term_at)[rows].sum())) or inner(self, query, rows, n))
    got = {n: dict(zip(shard.ids[docs].tolist(), s.tolist(), strict=True)) for n, docs, s in shard.search(places, at, tenth * floored)}
    asked = sum(df[t] for q in range(100) for t in tfs[20 * q])
    assert len(read) == 1 and read[0] < 0.3 * asked
    for q in range(100):
        best = [d for d in range(2000) if scores[q][d] >= tenth[q] - 1e-7]
        assert set(best) <= set(got[q]) and len(got[q]) < 20 and all(abs(got[q][d] - scores[q][d]) < 2e-6 for d in got[q])
