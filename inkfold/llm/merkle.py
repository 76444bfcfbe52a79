"""Merkle manifest of a dataset, with checkpoint-and-recompute proofs.

Every row is a leaf; per source the leaves form a tree of arity 3, and the subroots of the sources form one more. Of a tree
only every fourth level is stored. Four levels above a stored node hangs an aligned subtree of at most 81 stored nodes; all
work goes subtree by subtree: building hashes one up to its top, which is the next stored level, and proof extraction
regenerates its interior nodes from the stored ones below, emits the siblings of each, and forgets them. The siblings above
a subtree are the same for all its nodes and come from the next stored level, joined per subtree.

Positions come from a range partitioning with running counts, so a source of any size spans many tasks; equal rows
are counted first and numbered afterwards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.llm.common import crc32_sql, numbered_copies, rows_before, table
from inkfold.session import checkpointed, scratch_path

ARITY = 3
STORED_EVERY = 4
SUBTREE = ARITY**STORED_EVERY
# Rows of one range of positions, at most about.
BLOCK_ROWS = 250_000
# Subtrees whose proofs are in one batch: 20 * 81 proofs of some kilobytes.
PROOF_BATCH = 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a row of documents; ``text`` stands in for the text."""
    own = {"doc_id": F.col("doc_id").cast("bigint"), "n_chars": F.col("n_chars").cast("bigint"), "text": F.col("text") if text is None else text}
    return F.sha2(F.concat(*[_field(own.get(c, F.col(c)).cast("string")) for c in FIELDS]), 256)


def source_order(source: Column) -> Column:
    """A text that is never null and sorts as the source does, null first."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def _positions(rows: DataFrame, total: int, order: list[str]) -> DataFrame:
    """Add ``pos`` (from 0 within ``tree``) and ``n`` (rows of the tree); ``order`` tells rows of a tree apart."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_ROWS))
    spread = checkpointed(rows.repartitionByRange(parts, "tree", *order).withColumn("part", F.spark_partition_id().cast("bigint")))
    counts = spread.groupBy("tree", "part").agg(F.count("*").alias("n"))
    first = rows_before(counts, ["tree"], "part").withColumnRenamed("n", "_own")
    first = first.join(counts.groupBy("tree").agg(F.sum("n").alias("n")), "tree").select("tree", "part", "before", "n")
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    placed = spread.withColumn("pos", inside - 1).join(first, ["tree", "part"])
    return placed.withColumn("pos", F.col("pos") + F.col("before")).drop("part", "before")


def _hash(parts) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def subtree_levels(digests: list[str], nodes: int) -> list[list[str]]:
    """The levels of an aligned subtree from its stored nodes up, at most ``STORED_EVERY`` above them; ``nodes`` are the
    nodes of the whole tree at the stored level, whose last level holds one."""
    levels, left = [list(digests)], nodes
    while left > 1 and len(levels) <= STORED_EVERY:
        below = levels[-1]
        levels.append([_hash(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
        left = -(-left // ARITY)
    return levels


def _subtrees(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """One row per aligned subtree: its stored nodes in order."""
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *extra)))
    grouped = nodes.groupBy("tree", "n", F.floor(F.col("pos") / SUBTREE).alias("top")).agg(members.alias("members"))
    columns = [F.col(f"members.{c}").alias(c) for c in ("pos", "digest", *extra)]
    return grouped.select("tree", "n", "top", *columns)


def stored_levels(leaves: DataFrame, most: int, folder: str) -> list[DataFrame]:
    """Store every fourth level of the trees of ``leaves`` (tree, pos, n, digest, others): level 0 with all its columns,
    the others as (tree, pos, n, digest). ``most`` is the largest ``n``. The last one holds one node per tree: its root."""
    spark = leaves.sparkSession

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            top = [subtree_levels(list(d), n)[-1][0] for d, n in zip(batch["digest"], batch["n"], strict=True)]
            yield pd.DataFrame({"tree": batch["tree"], "pos": batch["top"], "n": -(-batch["n"] // SUBTREE), "digest": top})

    levels, left = [], most
    now = leaves
    while True:
        path = f"{folder}/level={STORED_EVERY * len(levels)}"
        now.write.parquet(path)
        levels.append(spark.read.parquet(path))
        if left <= 1:
            return levels
        now = _subtrees(levels[-1], []).mapInPandas(tops, "tree string, pos bigint, n bigint, digest string")
        left = -(-left // SUBTREE)


def _descend(levels: list[DataFrame], tops: DataFrame, extra: dict[str, str]) -> DataFrame:
    """Proofs of all nodes of level 0: (tree, pos, digest, extra, subroot, root, lefts, rights), the siblings left and right of the
    path at each level from below. ``tops`` (tree, subroot, root, lefts, rights) says how each tree goes on above its root."""
    upper = tops.select("tree", F.lit(0).cast("bigint").alias("top"), "subroot", "root", F.col("lefts").alias("up_lefts"), F.col("rights").alias("up_rights"))
    for level in reversed(range(len(levels))):
        names = list(extra) if level == 0 else []

        def siblings(batches: Iterator[pd.DataFrame], names=names) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), PROOF_BATCH):
                    rows = []
                    for r in batch.iloc[at : at + PROOF_BATCH].itertuples(index=False):
                        nodes = subtree_levels(list(r.digest), r.n)
                        up_left, up_right = list(r.up_lefts), list(r.up_rights)
                        others = [getattr(r, c) for c in names]
                        for i, digest in enumerate(r.digest):
                            left, right, k = [], [], i
                            for below in nodes[:-1]:
                                start = k - k % ARITY
                                left.append("".join(below[start:k]))
                                right.append("".join(below[k + 1 : start + ARITY]))
                                k //= ARITY
                            rows.append((r.tree, r.pos[i], digest, *[o[i] for o in others], r.subroot, r.root, left + up_left, right + up_right))
                    yield pd.DataFrame(rows, columns=["tree", "pos", "digest", *names, "subroot", "root", "lefts", "rights"])

        kinds = "".join(f"{c} {kind}, " for c, kind in extra.items() if c in names)
        schema = f"tree string, pos bigint, digest string, {kinds}subroot string, root string, lefts array<string>, rights array<string>"
        found = _subtrees(levels[level], names).join(upper, ["tree", "top"]).mapInPandas(siblings, schema)
        if level:
            upper = found.select("tree", F.col("pos").alias("top"), "subroot", "root", F.col("lefts").alias("up_lefts"), F.col("rights").alias("up_rights"))
    return found


def build_manifest(rows: DataFrame, folder: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored levels of the trees of the sources, and of the tree over their subroots.

    ``rows``: tree (from ``source_order``), doc_id, digest and one more digest, claim, that is kept with the leaf. Leaves
    ascend by doc_id, null first, then digest; equal rows are leaves of their own. No rows give levels without rows."""
    keys = ["tree", "doc_id", "digest", "claim"]
    # A key for a null id that sorts first.
    counted = checkpointed(rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("absent", F.col("doc_id").isNull()))
    sizes = counted.groupBy("tree").agg(F.sum("n").alias("n")).agg(F.max("n"), F.sum("n")).first()
    most, total = sizes[0] or 0, sizes[1] or 0
    leaves = numbered_copies(counted.fillna(0, ["doc_id"]), [*keys, "absent"])
    leaves = leaves.withColumn("present", ~F.col("absent")).drop("absent")
    placed = _positions(leaves, total, ["present", "doc_id", "digest", "claim", "copy"])
    placed = placed.withColumn("doc_id", F.when(F.col("present"), F.col("doc_id")))
    forest = stored_levels(placed.select("tree", "pos", "n", "digest", "doc_id", "claim"), most, f"{folder}/sources")
    subroots = checkpointed(forest[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"))
    sources = subroots.count()
    top = _positions(subroots, sources, ["source"]).select("tree", "pos", "n", "digest", "source")
    return forest, stored_levels(top, sources, f"{folder}/root")


def extract_proofs(manifest: tuple[list[DataFrame], list[DataFrame]]) -> DataFrame:
    """The proof of every leaf: doc_id, digest, claim, subroot, root, lefts, rights. Interior nodes are made anew per subtree."""
    forest, top = manifest
    none = F.array().cast("array<string>")
    root = top[-1].select("tree", F.lit("").alias("subroot"), F.col("digest").alias("root"), none.alias("lefts"), none.alias("rights"))
    subroots = _descend(top, root, {"source": "string"})
    tops = checkpointed(subroots.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "root", "lefts", "rights"))
    return _descend(forest, tops, {"doc_id": "bigint", "claim": "string"})


def fold_proof(leaf: Column) -> Column:
    """The root that follows from a leaf digest and the proof columns (lefts, rights)."""
    steps = F.arrays_zip(F.col("lefts"), F.col("rights"))
    return F.aggregate(steps, leaf, lambda node, step: F.sha2(F.concat(step["lefts"], node, step["rights"]), 256))


def proof_digest() -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), ""), 256)


def verify_rows(documents: DataFrame, claimed_text: Column, folder: str) -> DataFrame:
    """Build the manifest of ``documents`` (doc_id, source, lang, n_chars, text) in ``folder`` and check every row as it reads with
    ``claimed_text`` against its proof: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Null fields differ from empty ones. Rows without an id come first in their source; repeated rows are leaves of their own; a null source
    is a source of its own, before all others. An empty table gives an empty result. Other columns are ignored."""
    rows = documents.select(
        source_order(F.col("source")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf_digest().alias("digest"),
        leaf_digest(claimed_text).alias("claim"),
    )
    proofs = extract_proofs(build_manifest(rows, folder))
    folded = proofs.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest().alias("proof_sha256"), fold_proof(F.col("claim")).alias("folded_root")
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    # The contract's tampering: every document whose id has an even checksum loses its line ends.
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return verify_rows(documents, text, scratch_path(spark, "merkle"))


def _sql_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR)::VARCHAR || ':' || {value} END"


def _sql_tree(name: str, start: str, depth: int) -> str:
    """Nodes of each level (``name``0 to ``name``depth) of the trees of ``start`` (tree, pos, digest), and their siblings (``name``s0 ...).
    A tree of one node stays as it is."""
    out = f"{name}0 AS (SELECT tree, pos, digest, count(*) OVER (PARTITION BY tree) > 1 AS live FROM {start})"
    for k in range(depth):
        out += f""",
{name}s{k} AS (
  SELECT tree, pos, live,
         coalesce(string_agg(digest, '') OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k}
), {name}{k + 1} AS (
  SELECT tree, pos, digest, count(*) OVER (PARTITION BY tree) > 1 AS live FROM (
    SELECT tree, pos // 3 AS pos, CASE WHEN bool_or(live) THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE min(digest) END AS digest
    FROM {name}{k} GROUP BY tree, pos // 3)
)"""
    return out


def _sql_fold(name: str, start: str, tree: str, depth: int) -> str:
    """Rows of ``start`` (tree, pos, acc, sibs, others) folded up the tree: the last is ``name``depth."""
    out = f"{name}0 AS (SELECT * FROM {start})"
    for k in range(depth):
        out += f""",
{name}{k + 1} AS (
  SELECT f.* REPLACE (f.pos // 3 AS pos, CASE WHEN live THEN sha256(l || acc || r) ELSE acc END AS acc, sibs || l || r AS sibs)
  FROM {name}{k} f JOIN {tree}s{k} s ON s.tree = f.tree AND s.pos = f.pos
)"""
    return out


def merkle_sql(depth: int = 12, source_depth: int = 6) -> str:
    """SQL for the query: trees of at most 3 ** depth leaves and 3 ** source_depth sources, level by level."""
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(_sql_field(text if c == "text" else c) for c in FIELDS) + ")"

    return rf"""
WITH d AS (SELECT *, {crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 AND doc_id IS NOT NULL AS hit FROM documents),
e AS (SELECT *, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS claimed FROM d),
l AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, {leaf("text")} AS digest, {leaf("claimed")} AS claim FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest, claim) - 1 AS pos FROM l),
{_sql_tree("n", "p", depth)},
q AS (SELECT '' AS tree, tree AS source, digest, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n{depth}),
{_sql_tree("t", "q", source_depth)},
a AS (SELECT tree, pos, claim AS acc, '' AS sibs, doc_id, digest AS leaf FROM p),
{_sql_fold("f", "a", "n", depth)},
b AS (SELECT '' AS tree, q.pos, acc, sibs, doc_id, leaf, q.digest AS subroot FROM f{depth} f JOIN q ON q.source = f.tree),
{_sql_fold("g", "b", "t", source_depth)}
SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM g{source_depth}, (SELECT digest AS root FROM t{source_depth})"""


OP12_SQL = merkle_sql()
