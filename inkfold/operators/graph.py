"""Approximate nearest chunks over sharded neighbour graphs.

Chunks are dealt into shards by a hash of their key. Inside a shard every chunk is a node whose row lists its nearest
neighbours, the nodes that chose it, and a few far ones, so that greedy steps lead from anywhere to anywhere: a small world. The
graph is a table (``build_graph``) that can be stored and searched many times.

A search walks each shard's graph with a beam: the best nodes not yet expanded are opened, and of their neighbours only those
that look near by 256-bit sign sketches are scored. The hits of the shards are merged exactly. Every query visits every
shard, so recall does not depend on how vectors are spread over shards. A task holds one shard and streams the queries past it: neither
queries nor chunks go through the driver, and of the chunk table nothing is copied."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.operators.search import HIT_SCHEMA, SCORE_DIGITS, _cut, _matrix, sign_planes
from inkfold.session import checkpointed

SHARD_ROWS = 16_384
DEGREE = 16
FAR_LINKS = 2
BITS = 256
# The beam is this share of a shard, and no narrower than ``LEAST_BEAM``.
BEAM_SHARE = 1 / 200
LEAST_BEAM = 24
# Of the neighbours of opened nodes, the nearest by sketch are scored: this share.
SCORED_SHARE = 0.3
OPENED = 4
ENTRIES = 8
QUERY_BLOCK = 512
GRAPH_SCHEMA = (
    "shard bigint, node int, point_key bigint, document_id bigint, chunk_index bigint, vector array<float>, neighbours array<int>"
)


@lru_cache(maxsize=4)
def _planes(dims: int) -> np.ndarray:
    return sign_planes(dims, BITS).T


def sketches(unit: np.ndarray) -> np.ndarray:
    """Sides of ``BITS`` fixed planes, as 64-bit words."""
    if not len(unit):
        return np.zeros((0, BITS // 64), np.uint64)
    return np.packbits(unit @ _planes(unit.shape[1]) >= 0, axis=1).view(np.uint64)


def link_nodes(unit: np.ndarray, degree: int = DEGREE) -> list[np.ndarray]:
    """Neighbour lists: the ``degree`` nearest, up to as many of the nearest that chose this node, and ``FAR_LINKS`` far ones."""
    n = len(unit)
    k = min(degree, n - 1)
    nearest = np.zeros((n, k), np.int32)
    near = np.zeros((n, k))
    for start in range(0, n, 1024):
        scores = unit[start : start + 1024] @ unit.T
        own = np.arange(len(scores))
        scores[own, start + own] = -9.0
        if k:
            picked = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            nearest[start : start + 1024], near[start : start + 1024] = picked, np.take_along_axis(scores, picked, axis=1)
    source, target, score = np.repeat(np.arange(n), k), nearest.ravel(), near.ravel()
    order = np.lexsort((source, -score, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target, side="left")
    source, target = source[place < degree], target[place < degree]
    chosen_by = np.split(source, np.searchsorted(target, np.arange(1, n)))
    # A ring in a shuffled order joins all nodes; its steps go far.
    ring = np.random.default_rng(n).permutation(n)
    far = np.zeros((n, 2), np.int32)
    far[ring, 0], far[ring, 1] = np.roll(ring, 1), np.roll(ring, -1)
    lists = (np.unique(np.concatenate([nearest[i], chosen_by[i], far[i, :FAR_LINKS]])) for i in range(n))
    return [links[links != i].astype(np.int32) for i, links in enumerate(lists)]


def build_graph(chunks: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE) -> DataFrame:
    """The graph of ``chunks`` (point_key, document_id, chunk_index, vector), one row per chunk: shard, node, the
    chunk's columns, neighbours. Shards hold about ``shard_rows`` chunks, so a task builds one from a bounded block."""
    chunks = chunks.select("point_key", "document_id", "chunk_index", F.col("vector").cast("array<float>").alias("vector"))
    shards = max(1, -(-chunks.count() // shard_rows))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["document_id", "chunk_index", "point_key"], kind="stable").reset_index(drop=True)
        unit, _ = _matrix(rows["vector"])
        return rows.assign(node=np.arange(len(rows), dtype=np.int32), neighbours=link_nodes(unit, degree))[[c.split()[0] for c in GRAPH_SCHEMA.split(", ")]]

    placed = chunks.withColumn("shard", F.pmod(F.xxhash64("point_key"), F.lit(shards)))
    return placed.groupBy("shard").applyInPandas(build, GRAPH_SCHEMA)


class Shard:
    """One shard in memory, and the search of query blocks in it."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        self.rows = rows[["point_key", "document_id", "chunk_index"]]
        self.size = n = len(rows)
        unit, _ = _matrix(rows["vector"])
        # One more row stands for no node.
        self.vectors = np.vstack([unit, np.zeros(unit.shape[1])])
        self.sketch = np.vstack([sketches(unit), np.zeros((1, BITS // 64), np.uint64)])
        width = max(map(len, rows["neighbours"]), default=0)
        self.links = np.full((n + 1, max(width, 1)), n, dtype=np.int32)
        for i, links in enumerate(rows["neighbours"]):
            self.links[i, : len(links)] = links
        self.entries = np.unique(np.linspace(0, n - 1, max(ENTRIES, int(n**0.5))).astype(np.int64))

    def _apart(self, sketch: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.sketch[nodes] ^ sketch[:, None, :]).sum(axis=2, dtype=np.int64)

    def search(self, unit: np.ndarray, keep: int, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Nodes and scores of the best hits of each query (``size`` and -inf where there are fewer), and the pairs scored."""
        q, n = len(unit), self.size
        sketch = sketches(unit)
        seen = np.zeros((q, n + 1), dtype=bool)
        seen[:, n] = True
        first = np.broadcast_to(self.entries, (q, len(self.entries)))
        take = min(ENTRIES, first.shape[1])
        nodes = np.take_along_axis(first, np.argsort(self._apart(sketch, first), axis=1, kind="stable")[:, :take], axis=1)
        scores = np.einsum("qd,qed->qe", unit, self.vectors[nodes])
        np.put_along_axis(seen, nodes, True, axis=1)
        beam = max(beam, keep, take)
        held = np.full((q, beam), n, dtype=np.int64)
        value = np.full((q, beam), -np.inf)
        opened = np.zeros((q, beam), dtype=bool)
        held[:, :take], value[:, :take] = nodes, scores
        going = np.arange(q)
        while len(going):
            waiting = np.where(opened[going], -np.inf, value[going])
            best = np.argpartition(-waiting, OPENED - 1, axis=1)[:, :OPENED]
            alive = np.take_along_axis(waiting, best, axis=1) > -np.inf
            some = alive.any(axis=1)
            going, best, alive = going[some], best[some], alive[some]
            if not len(going):
                break
            opened[going[:, None], best] = True
            picks = np.where(alive, held[going[:, None], best], n)
            near = np.sort(self.links[picks].reshape(len(going), -1), axis=1)
            fresh = ~seen[going[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            apart = np.where(fresh, self._apart(sketch[going], near), 1 << 20)
            wanted = np.ceil(SCORED_SHARE * fresh.sum(axis=1)).astype(np.int64)
            most = int(wanted.max(initial=0))
            if not most:
                continue
            order = np.argsort(apart, axis=1, kind="stable")[:, :most]
            chosen = np.where(np.arange(most) < wanted[:, None], np.take_along_axis(near, order, axis=1), n)
            found = np.einsum("qd,qmd->qm", unit[going], self.vectors[chosen])
            found[chosen == n] = -np.inf
            seen[going[:, None], chosen] = True
            all_nodes = np.concatenate([held[going], chosen], axis=1)
            all_values = np.concatenate([value[going], found], axis=1)
            all_opened = np.concatenate([opened[going], np.zeros(chosen.shape, dtype=bool)], axis=1)
            top = np.argpartition(-all_values, beam - 1, axis=1)[:, :beam]
            held[going], value[going] = np.take_along_axis(all_nodes, top, axis=1), np.take_along_axis(all_values, top, axis=1)
            opened[going] = np.take_along_axis(all_opened, top, axis=1)
        rounded = np.round(value, SCORE_DIGITS)
        order = np.lexsort((held, -rounded), axis=1)[:, :keep]
        return np.take_along_axis(held, order, axis=1), np.take_along_axis(rounded, order, axis=1), int(seen[:, :n].sum())

    def hits(self, ids: np.ndarray, vectors: pd.Series, keep: int, beam: int) -> pd.DataFrame:
        unit, _ = _matrix(vectors)
        nodes, scores, _ = self.search(unit, keep, beam)
        real = scores > -np.inf
        out = self.rows.iloc[nodes[real]].reset_index(drop=True)
        out.insert(0, "query_id", np.broadcast_to(ids[:, None], nodes.shape)[real])
        out["score"] = scores[real]
        return out


def search_graph(
    queries: DataFrame, graph: DataFrame, keep: int, beam_share: float = BEAM_SHARE, least_beam: int = LEAST_BEAM
) -> DataFrame:
    """The ``keep`` best chunks found for each query (query_id, vector) by cosine similarity, with ``rank``. Ties: document id,
    chunk index, point key; an empty graph gives no hits."""
    shards = graph.agg(F.coalesce(F.max("shard"), F.lit(-1))).first()[0] + 1
    if not shards:
        return queries.sparkSession.createDataFrame([], HIT_SCHEMA).withColumn("rank", F.lit(0))
    asked = queries.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"), F.lit(1).alias("kind"),
        "query_id", F.col("vector").cast("array<float>").alias("vector"),
    )
    both = graph.withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    dealt = both.repartitionById(int(shards), F.col("shard").cast("int")).sortWithinPartitions("shard", "kind")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, shard = None, [], None
        for frame in frames:
            for name, own in frame.groupby("shard", sort=True):
                if name != now:
                    now, parts, shard = name, [], None
                nodes, rows = own[own["kind"] == 0], own[own["kind"] == 1]
                if len(nodes):
                    parts.append(nodes)
                for start in range(0, len(rows), QUERY_BLOCK):
                    if shard is None:
                        if not parts:
                            break
                        shard, parts = Shard(pd.concat(parts)), []
                    block = rows.iloc[start : start + QUERY_BLOCK]
                    beam = max(least_beam, int(shard.size * beam_share))
                    yield shard.hits(block["query_id"].to_numpy().astype(np.int64), block["vector"], keep, beam)

    return _cut(dealt.mapInPandas(walk, HIT_SCHEMA), keep)


def approx_graph_chunks(
    queries: DataFrame, chunks: DataFrame, keep: int, shard_rows: int = SHARD_ROWS, beam_share: float = BEAM_SHARE
) -> DataFrame:
    """``search_graph`` on a graph built for this search."""
    return search_graph(queries, checkpointed(build_graph(chunks, shard_rows)), keep, beam_share)
