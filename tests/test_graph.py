import numpy as np
import pandas as pd
import pytest

from inkfold.operators import graph as G
from inkfold.operators import search as S
from inkfold.plans import registry
from inkfold.plans.views import Tables

CHUNKS = "point_key BIGINT, document_id BIGINT, chunk_index BIGINT, vector ARRAY<FLOAT>"


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_registered_recall(spark, folder):
    """The registered query with its own settings finds 0.9 of the true 15 nearest, with and without the query's own vector, of
    every row whose id is divisible by 100, among all rows."""
    t = Tables(spark, folder)
    asked = t.queries.where("query_id % 100 = 0")
    exact = {(r.query_id, r.point_key) for r in S.nearest_chunks(asked, t.vectors, 15).collect()}
    found = {(r.query_id, r.point_key) for r in registry.QUERIES["approx_knn_graph"](spark, folder).collect()}
    others = {(q, p) for q, p in exact if q != p}
    assert len(found & exact) / len(exact) >= 0.9 and len(found & others) / len(others) >= 0.9
    assert {q for q, _ in found} == {r.query_id for r in asked.collect()}


def test_registered_recall_in_a_full_shard(spark, tmp_path):
    """A nearly full shard of vectors without any clusters."""
    matrix = np.random.default_rng(9).normal(size=(14_000, 96)).astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(len(matrix)), "embedding": list(matrix)}).to_parquet(f"{tmp_path}/embeddings.parquet")
    pd.DataFrame({"doc_id": [0]}).to_parquet(f"{tmp_path}/documents.parquet")
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    exact = {(100 * i, int(j)) for i, js in enumerate(np.argsort(-(unit[::100] @ unit.T), axis=1)[:, :15]) for j in js}
    found = {(r.query_id, r.point_key) for r in registry.QUERIES["approx_knn_graph"](spark, str(tmp_path)).collect()}
    assert len(found) == len(exact) and len(found & exact) / len(exact) >= 0.9


def test_registered_walks(spark, tmp_path, monkeypatch):
    """Only the rows whose id is divisible by 100 walk the graph, once a shard; each gets its hits."""
    rng = np.random.default_rng(8)
    walks = spark.sparkContext.accumulator(0)
    hits = G.Shard.hits

    def counted(self, ids, *rest):
        walks.add(len(ids))
        return hits(self, ids, *rest)

    monkeypatch.setattr(G.Shard, "hits", counted)
    rows = [(i, i % 5, rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0,)], "doc_id bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["approx_knn_graph"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == set(range(0, 600, 100)) and len(got) == 6 * 15 and walks.value == 6


def test_registered_asks_for_every_row(spark, tmp_path):
    """Each row of the table is a query, whatever its id, and gets its hits among all rows."""
    matrix = np.random.default_rng(10).normal(size=(250, 8)).astype(np.float32)
    ids = np.arange(250) * 7 + 1
    pd.DataFrame({"vec_id": ids, "embedding": list(matrix)}).to_parquet(f"{tmp_path}/embeddings.parquet")
    pd.DataFrame({"doc_id": [0]}).to_parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["approx_knn_graph"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == {r.point_key for r in got} == set(ids.tolist()) and len(got) == 250 * 15
    assert {(r.query_id, r.point_key) for r in got if r["rank"] == 1} == {(i, i) for i in ids.tolist()}


def shard_of(matrix):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    n = len(unit)
    rows = pd.DataFrame({"node": range(n), "point_key": range(n), "document_id": range(n), "chunk_index": 0, "vector": list(matrix)})
    return G.Shard(rows.assign(neighbours=G.link_nodes(unit))), unit


@pytest.mark.parametrize("n, most", [(500, 0.3), (6000, 0.08)])
def test_pairs_scored(n, most):
    """Vectors without any clusters: recall of 0.9 from a part of the pairs that falls with the size of the shard."""
    matrix = np.random.default_rng(n).normal(size=(n, 64))
    shard, unit = shard_of(matrix)
    asked = unit[:200]
    beam = max(G.LEAST_BEAM, int(n * G.BEAM_SHARE))
    nodes, scores, scored = shard.search(asked, 15, beam)
    exact = np.argsort(-(asked @ unit.T), axis=1)[:, :15]
    assert np.mean([len(set(a) & set(b)) / 15 for a, b in zip(nodes, exact, strict=True)]) >= 0.9
    assert scored <= most * n * len(asked)
    assert np.allclose(scores[:, 0], 1) and (np.diff(scores, axis=1) <= 0).all()


def test_every_node_can_be_reached():
    """Two far clusters and many equal vectors still are one graph."""
    rng = np.random.default_rng(1)
    matrix = np.vstack([rng.normal(size=(100, 8)) + 50, rng.normal(size=(100, 8)) - 50, np.ones((60, 8))])
    shard, _ = shard_of(matrix)
    reached, front = {0}, [0]
    while front:
        front = [int(j) for i in front for j in shard.links[i] if j < shard.size and j not in reached and not reached.add(int(j))]
    assert len(reached) == shard.size


def test_shards_merge_and_small_tables(spark):
    rng = np.random.default_rng(3)
    data = [(i, i // 3, i % 3, rng.normal(size=16).tolist()) for i in range(300)] + [(900, 900, 0, [0.0] * 16)]
    chunks = spark.createDataFrame(data, CHUNKS)
    queries = chunks.selectExpr("point_key AS query_id", "vector")
    exact = S.nearest_chunks(queries, chunks, 5).where("query_id < 300")
    found = G.approx_graph_chunks(queries, chunks, 5, shard_rows=60).where("query_id < 300")
    key = lambda df: {(r.query_id, r.rank, r.point_key) for r in df.collect()}
    assert len(key(exact) & key(found)) >= 0.97 * len(key(exact))
    for n in (0, 1, 2, 4):
        some = chunks.where(f"point_key < {n}")
        assert key(G.approx_graph_chunks(queries.where("query_id < 4"), some, 5)) == key(S.nearest_chunks(queries.where("query_id < 4"), some, 5))
    assert G.approx_graph_chunks(queries.limit(0), chunks, 5).count() == 0


def test_graph_is_a_table(spark, tmp_path):
    rng = np.random.default_rng(4)
    chunks = spark.createDataFrame([(i, i, 0, rng.normal(size=8).tolist()) for i in range(100)], CHUNKS)
    path = str(tmp_path / "graph")
    G.build_graph(chunks, shard_rows=40).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 100 and stored.where("size(neighbours) = 0").count() == 0
    hits = G.search_graph(chunks.selectExpr("point_key AS query_id", "vector"), stored, 1)
    assert {(r.query_id, r.point_key) for r in hits.collect()} == {(i, i) for i in range(100)}
