import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.operators import search as S
from inkfold.plans import registry
from inkfold.plans.views import Tables

CHUNKS = "point_key BIGINT, document_id BIGINT, chunk_index BIGINT, vector ARRAY<FLOAT>"
QUERIES = "query_id BIGINT, user_id BIGINT, vector ARRAY<FLOAT>"


@pytest.fixture(scope="module")
def t(spark, sf):
    return Tables(spark, sf)


def as_set(hits):
    return {(r.query_id, r.rank, r.point_key) for r in hits.collect()}


def brute(t, keep):
    chunks = t.vectors.toPandas().sort_values(["document_id", "chunk_index", "point_key"])
    queries = t.queries.select("query_id", "vector").toPandas()
    c = np.vstack(chunks["vector"]).astype(float)
    q = np.vstack(queries["vector"]).astype(float)
    scores = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T, 9)
    out = set()
    for i, qid in enumerate(queries["query_id"]):
        for rank, j in enumerate(np.argsort(-scores[i], kind="stable")[:keep]):
            out.add((qid, rank + 1, chunks["point_key"].iloc[j]))
    return out


def test_exact_search_equals_brute_force(t):
    want = brute(t, 15)
    assert as_set(S.nearest_chunks(t.queries, t.vectors, 15)) == want
    # The same in tiny blocks of queries.
    grid = S.nearest_chunks(t.queries, t.vectors, 15, query_bytes=3000)
    assert as_set(grid) == want


def test_copies_of_one_chunk_stay_whole(spark):
    """Equal vectors: ties go by document and chunk; nothing is lost in any number of blocks."""
    chunks = spark.createDataFrame([(i, i % 40, i // 40, [1.0, 0.0]) for i in range(400)], CHUNKS)
    queries = spark.createDataFrame([(q, 0, [1.0, 0.1]) for q in range(30)], QUERIES)
    want = [(d, i) for d in range(40) for i in range(10)][:25]
    for options in ({}, {"query_bytes": 64}):
        hits = S.nearest_chunks(queries, chunks, 25, **options).orderBy("query_id", "rank").collect()
        assert [(h.document_id, h.chunk_index) for h in hits] == want * 30


def test_approximate_search_recall(t):
    exact = {(q, p) for q, _, p in brute(t, 10)}
    hits = S.approx_nearest_chunks(t.queries, t.vectors, 10, planes=5, flips=2, block_rows=60)
    found = {(r.query_id, r.point_key) for r in hits.collect()}
    assert len(found & exact) / len(exact) > 0.6
    everything = S.approx_nearest_chunks(t.queries, t.vectors, 10, planes=5, flips=5)
    assert {(r.query_id, r.point_key) for r in everything.collect()} == exact


def test_best_chunk_overfetch_and_fallback(spark):
    chunks = spark.createDataFrame(
        [(0, 1, 0, [1.0, 0.0]), (1, 1, 1, [0.9, 0.1]), (2, 2, 0, [0.0, 1.0]), (3, 3, 0, [-1.0, 0.0])], CHUNKS
    )
    queries = spark.createDataFrame([(7, 0, [1.0, 0.0]), (8, 0, [-0.2, -1.0])], QUERIES)
    found = {r.query_id: r for r in S.semantic_search(queries, chunks, k=2).collect()}
    assert [r.document_id for r in found[7].results] == [1, 2] and not found[7].fallback_to_keyword
    assert found[7].results[0].chunk_index == 0
    # All scores are below the threshold: the results stay.
    assert len(found[8].results) == 2 and found[8].fallback_to_keyword


def test_no_chunks_and_no_store(spark):
    queries = spark.createDataFrame([(7, 0, [1.0, 0.0])], QUERIES)
    for store in (None, spark.createDataFrame([], CHUNKS)):
        row = S.semantic_search(queries, store).first()
        assert row.results == [] and row.fallback_to_keyword and row.top_similarity_score == 0.0


def test_fewer_documents_than_k(spark):
    """3k chunks of one document leave one result."""
    chunks = spark.createDataFrame([(i, 1, i, [1.0, 0.0]) for i in range(20)] + [(99, 2, 0, [0.5, 0.5])], CHUNKS)
    queries = spark.createDataFrame([(1, 0, [1.0, 0.0])], QUERIES)
    assert [r.document_id for r in S.semantic_search(queries, chunks, k=5).first().results] == [1]


def test_merge_with_keyword_results(spark):
    queries = spark.createDataFrame([(1, 5, [3, 1]), (2, 5, [])], "query_id BIGINT, user_id BIGINT, keyword_ids ARRAY<BIGINT>")
    hits = spark.createDataFrame(
        [(1, "1", 0.9), (1, "7", 0.8), (1, "9", 0.7), (1, "x7", 0.95)], "query_id BIGINT, document_id STRING, score DOUBLE"
    )
    acl = spark.createDataFrame([(5, 1), (5, 7)], "user_id BIGINT, document_id BIGINT")
    got = {r.query_id: r for r in S.merge_keyword_semantic(queries, hits, acl).collect()}
    assert (got[1].merged_ids, got[1].ml_semantic_added, got[1].total) == ([3, 1, 7], 1, 3)
    assert (got[2].merged_ids, got[2].ml_semantic_added, got[2].total) == ([], 0, 0)


def test_query_events(spark):
    queries = spark.createDataFrame(
        [(1, 5, "", "find it", [3], [1.0, 0.0])],
        "query_id BIGINT, user_id BIGINT, session_id STRING, query_text STRING, keyword_ids ARRAY<BIGINT>, vector ARRAY<FLOAT>",
    )
    chunks = spark.createDataFrame([(0, 8, 0, [1.0, 0.0])], CHUNKS)
    acl = spark.createDataFrame([(5, 8)], "user_id BIGINT, document_id BIGINT")
    merged = S.merge_keyword_semantic(queries, S.semantic_hits(queries, chunks), acl)
    row = S.query_events(merged, S.semantic_search(queries, chunks)).first()
    assert row.session_id == "anonymous" and row.merged_result_ids == [3, 8]
    assert (row.keyword_result_count, row.semantic_result_count, row.fallback_to_keyword) == (1, 1, False)


def test_valid_queries(spark):
    df = spark.createDataFrame([("ab",), (" ab",), ("abc",), ("äöü",)], "query_text STRING")
    assert S.valid_queries(df).count() == 3
    assert S.valid_queries(df, strip=True).count() == 2


def test_encoder_and_pooling(spark, t):
    chunks = S.encode_texts(S.chunk_text(t.docs), S.hashing_encoder)
    rows = chunks.select("chunk_text", "vector").limit(50).collect()
    encode = S.hashing_encoder()
    assert all(np.allclose(encode([r.chunk_text])[0], r.vector, atol=1e-6) for r in rows)
    tokens = spark.createDataFrame([(1, [1.0, 3.0], 1), (1, [3.0, 5.0], 1), (1, [9.0, 9.0], 0), (2, [1.0, 1.0], 0)], "id INT, vector ARRAY<FLOAT>, mask INT")
    got = {r.id: r.vector for r in S.mean_pool(tokens, 2).collect()}
    assert got == {1: [2.0, 4.0], 2: [None, None]}


def test_registered_approximate_search_recall(spark, sf, t):
    """The registered query, with its own settings: at least 0.9 of the true 15 nearest, and without the query's own vector."""
    exact = {(q, p) for q, _, p in brute(t, 15)}
    found = {(r.query_id, r.point_key) for r in registry.QUERIES["approx_knn"](spark, sf).collect()}
    assert len(found & exact) / len(exact) >= 0.9
    others = {(q, p) for q, p in exact if q != p}
    assert len(found & others) / len(others) >= 0.9


def test_exact_search_in_many_blocks(spark, monkeypatch):
    """Several partitions of several blocks on both sides, copies across blocks; nothing is brought to the driver."""
    rng = np.random.default_rng(5)
    vectors = np.vstack([rng.normal(size=(150, 8)), np.ones((90, 8)), np.zeros((3, 8))]).astype(np.float32)
    rows = [(i, i * 7 % 50, i * 7 // 50, v.tolist()) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    queries = chunks.selectExpr("point_key AS query_id", "vector")
    monkeypatch.setattr(S, "QUERY_BYTES", 1280)
    monkeypatch.setattr(S, "PASSING", 4)
    monkeypatch.setattr(type(queries), "toPandas", lambda *_: pytest.fail("a table came to the driver"))
    lengths = np.linalg.norm(vectors.astype(float), axis=1)
    unit = vectors / np.where(lengths == 0, 1, lengths)[:, None]
    scores = np.round(unit @ unit.T, 9)
    keys = np.array([r[:3] for r in rows])
    want = set()
    for q in range(len(rows)):
        for rank, j in enumerate(np.lexsort((keys[:, 0], keys[:, 2], keys[:, 1], -scores[q]))[:6]):
            want.add((q, rank + 1, j))
    assert as_set(S.nearest_chunks(queries, chunks, 6, query_bytes=2048)) == want
