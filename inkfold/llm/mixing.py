"""Mixing sources to target weights by entropy balancing.

Document rates are the ones closest to 1 (in relative entropy, weighted by size) whose tokens meet the targets. They
have the form ``exp(sum of the multipliers of the document's groups)``; the multipliers minimise a convex dual. Each
Newton step sums the tokens of every group under the present rates, over cells (one row per combination of groups), so
its cost does not depend on the number of documents. Rates are rounded to whole copies by systematic sampling within
each source in order of size; of sixteen starting offsets the one that comes nearest to the target is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.llm.common import table, whole_text
from inkfold.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
# Weights of the sources in code point order, null last, repeating (fixed values).
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
OFFSETS = 16
# Documents of one source and size are numbered within ranges of so many ids.
ID_RANGE = 65536
TOLERANCE = 1e-10
STEPS = 200


# A source's row is joined to its documents in so many copies, so that no task has to hold a whole source.
SALTS = 64


def join_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (skey, doc_id, size, ...) with the columns of their source, spread over ``SALTS`` keys per source."""
    salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS))
    copies = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return rows.withColumn("salt", salt).join(copies, ["skey", "salt"]).drop("salt")


def source_key(source: Column) -> Column:
    """A text that is never null and sorts as the source does, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def capped_targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to (skey, source_size): all sizes shared by weight, no source above ``most`` times its size, the
    excess reshared by weight. One row per source, so the three windows without partition are over sources only.

    Sorted by size / weight, the capped sources come first; the level of the others is what the capped leave over,
    divided by the other weights."""
    cycle = F.array(*map(F.lit, weights))
    place = F.row_number().over(Window.orderBy("skey"))
    w = F.get(cycle, (place - 1) % len(weights))
    rows = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before) / rest
    rows = rows.withColumn("level", level)
    free = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    # The level falls as long as sources are capped; the first that fits is the largest.
    rows = rows.withColumn("level", F.coalesce(F.max(free).over(everything), F.lit(0.0)))
    return rows.select("skey", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def entropy_rates(cells: DataFrame, margins: dict[str, DataFrame], tokens: str = "tokens") -> DataFrame:
    """Adds ``rate`` to ``cells`` (one row per combination of the margin columns, with its tokens), so that for every
    margin column the tokens times rates meet its targets (column value, ``target``).

    Newton's method on the dual, one margin after the other; with one margin its Hessian is diagonal, so this is the
    full Newton step. A target of zero gives rate zero; a value without tokens cannot meet its target and is left out.
    Steps are held within +-2. Margins that contradict one another raise after ``STEPS`` rounds."""
    state = checkpointed(cells.withColumn("lam", F.lit(0.0)))
    for _ in range(STEPS):
        worst = 0.0
        for margin, targets in margins.items():
            now = state.groupBy(margin).agg(F.sum(F.col(tokens) * F.exp("lam")).alias("now"))
            want = targets.select(margin, "target")
            gap = F.abs(F.col("now") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
            step = (
                F.when(F.col("target") <= 0, F.lit(-1e9))
                .when(F.col("now") <= 0, F.lit(0.0))
                .otherwise(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("target") / F.col("now") - 1)))
            )
            moves = now.join(want, margin).select(margin, step.alias("step"), F.when(F.col("now") > 0, gap).alias("gap"))
            moved = state.join(moves, margin, "left")
            state = checkpointed(
                moved.withColumn("lam", F.col("lam") + F.coalesce("step", F.lit(0.0))).drop("step").withColumnRenamed("gap", "gap_" + margin)
            )
            worst = max(worst, state.agg(F.max("gap_" + margin)).first()[0] or 0.0)
            state = state.drop("gap_" + margin)
        if worst <= TOLERANCE:
            return state.withColumn("rate", F.exp("lam")).drop("lam")
    raise ValueError(f"the targets cannot be met together: off by {worst:.3g} of a target")


def mix_sources(df: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per row of ``df`` (doc_id, text, source): size (words), source_size, target (of its source), copies
    (0 to ``most``), taken (copies times size).

    Null texts are empty; a null source is a source of its own, after all others. Documents without words are taken
    zero times or as the sampling has it, which adds nothing. Rows of equal (source, size, doc_id) are alike. An empty
    table gives an empty result. Other columns are ignored. Reruns agree.

    Documents of a source are numbered by (size, doc_id) without bringing a source together: counts per (source, size)
    and per (source, size, id range) give each group its first number, and only such a group is sorted."""
    sized = checkpointed(
        df.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            source_key(F.col("source").cast("string")).alias("skey"),
            F.regexp_count(whole_text(), F.lit(WORD)).cast("bigint").alias("size"),
        )
    )
    sources = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    targets = checkpointed(capped_targets(sources, weights, most))
    cells = targets.select("skey", F.col("source_size").alias("tokens"))
    rates = entropy_rates(cells, {"skey": targets}).select("skey", F.round("rate", 9).alias("rate"))

    ranged = sized.withColumn("ids", F.floor(F.coalesce("doc_id", F.lit(0)) / ID_RANGE))
    groups = ranged.groupBy("skey", "size", "ids").agg(F.count("*").alias("n"))
    earlier = Window.unboundedPreceding, -1
    sizes = groups.groupBy("skey", "size").agg(F.sum("n").alias("n"))
    sizes = sizes.select(
        "skey", "size", F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("size").rowsBetween(*earlier)), F.lit(0)).alias("below")
    )
    in_size = F.coalesce(F.sum("n").over(Window.partitionBy("skey", "size").orderBy("ids").rowsBetween(*earlier)), F.lit(0))
    first = groups.withColumn("inside", in_size).join(sizes, ["skey", "size"]).select("skey", "size", "ids", (F.col("below") + F.col("inside")).alias("first"))
    number = F.row_number().over(Window.partitionBy("skey", "size", "ids").orderBy("doc_id"))
    numbered = ranged.withColumn("number", number).join(first, ["skey", "size", "ids"])
    ranked = checkpointed(
        join_sources(numbered.select("doc_id", "skey", "size", (F.col("number") + F.col("first")).alias("rank")), rates)
    )

    def copies(offset: Column) -> Column:
        upto = F.col("rate") * F.col("rank") + offset
        return (F.floor(upto) - F.floor(F.col("rate") * (F.col("rank") - 1) + offset)).cast("bigint")

    tried = ranked.groupBy("skey").agg(
        *[F.sum(F.col("size") * copies(F.lit((j + 0.5) / OFFSETS))).alias(f"o{j}") for j in range(OFFSETS)]
    )
    misses = F.array(*[F.struct(F.abs(F.col(f"o{j}") - F.col("target")).alias("miss"), F.lit((j + 0.5) / OFFSETS).alias("offset")) for j in range(OFFSETS)])
    chosen = tried.join(targets, "skey").select("skey", "source_size", "target", F.array_min(misses)["offset"].alias("offset"))
    out = join_sources(ranked, chosen).withColumn("copies", copies(F.col("offset")))
    return out.select(
        "doc_id", "skey", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def take_copies(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``df`` as often as ``decisions`` (of ``mix_sources`` on the same ``df``) says, columns unchanged."""
    keys = ["doc_id", "skey", "size"]
    by_key = Window.partitionBy(*keys)
    own = df.select(
        F.struct(*[F.col(c) for c in df.columns]).alias("row"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**62))).alias("doc_id"),
        source_key(F.col("source").cast("string")).alias("skey"),
        F.regexp_count(whole_text(), F.lit(WORD)).cast("bigint").alias("size"),
    ).withColumn("nth", F.row_number().over(by_key.orderBy(F.xxhash64("row"))))
    told = decisions.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**62))))
    told = told.withColumn("nth", F.row_number().over(by_key.orderBy("copies"))).where("copies > 0").select(*keys, "nth", "copies")
    taken = own.join(told, [*keys, "nth"])
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents")).drop("skey", "copies")


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size,
         ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY skey) - 1) % 3] AS weight FROM d GROUP BY skey
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT skey, source_size, least(3.0::DOUBLE * source_size,
         weight * max(CASE WHEN level <= 3.0::DOUBLE * source_size / weight THEN level END) OVER ()) AS target FROM l
), r AS (
  SELECT d.*, source_size, target, row_number() OVER (PARTITION BY d.skey ORDER BY size, doc_id) AS rank,
         CASE WHEN target > 0 THEN round(target / source_size, 9) ELSE 0 END AS rate FROM d JOIN t USING (skey)
), o AS (
  SELECT skey, (j + 0.5::DOUBLE) / 16 AS u, abs(sum(size * (floor(rate * rank + (j + 0.5::DOUBLE) / 16) - floor(rate * (rank - 1) + (j + 0.5::DOUBLE) / 16))) - any_value(target)) AS miss
  FROM r, range(16) AS q(j) GROUP BY skey, j
), c AS (SELECT skey, arg_min(u, miss + u * 1e-9) AS u FROM o GROUP BY skey)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate * rank + u) - floor(rate * (rank - 1) + u)) AS BIGINT) AS taken
FROM r JOIN c USING (skey)"""
