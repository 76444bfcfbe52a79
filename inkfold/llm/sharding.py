"""Sharding by proportional stratified interleaving.

The rows of each source are put into a seeded random order; row ``r`` (from 0) of a source of ``n`` rows gets the fractional
rank ``(r + phase) / n``, with a phase of its own per source, so that small sources do not meet in one place. Sorted by
fractional rank, every stretch of rows holds every source in its share, so contiguous cuts of equal row counts give shards
that match the mixture, to about two rows a source.

Nothing is sorted as a whole. Random keys and fractional ranks are spread evenly by construction, so both orders are cut
into buckets of about ``BUCKET_ROWS`` rows, however many rows one source has; running sums over bucket counts (in two
levels) give each bucket its first position, and only the rows of a bucket are sorted. Equal rows are counted before they
are numbered, so a row that repeats without end is no hot key either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.llm.common import crc32_sql, numbered_copies, rows_before, table, whole_text
from inkfold.llm.mixing import source_key
from inkfold.session import checkpointed

SEED = 17
SHARDS = 8
BUCKET_ROWS = 512
IDENTITY = ["skey", "dkey", "size", "text_crc32"]


def _unit32(hex_digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as an integer."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("bigint")


def _identity(df: DataFrame) -> list[Column]:
    """What tells rows apart: source, id, size and checksum of the text. A null source and a null id are values of their own."""
    raw = F.encode(whole_text(), "UTF-8")
    return [
        source_key(F.col("source").cast("string")).alias("skey"),
        F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("-")).alias("dkey"),
        (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).cast("bigint").alias("text_crc32"),
    ]


def assign_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``df`` (doc_id, text, source): doc_id, skey (source), size (bytes of the text and 1), text_crc32,
    copy (number among rows equal in these), rank (in the source), fraction, shard (0 to ``shards`` - 1), slot (from 0, no gaps).

    Shards differ by at most one row. A null text is empty (size 1, checksum 0); a null source is a source of its own. Rows equal in id,
    source, size and checksum are interchangeable. With fewer rows than shards some shards are empty; an empty table gives an
    empty result. Other columns are ignored. The result depends on the rows and the seed only, not on their partitions."""
    counted = checkpointed(df.select(*_identity(df)).groupBy(*IDENTITY).agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // bucket_rows))
    rows = numbered_copies(counted, IDENTITY)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "dkey", F.col("size").cast("string"), F.col("text_crc32").cast("string"), F.col("copy").cast("string")))
    keyed = rows.withColumn("key", key).withColumn("bucket", F.shiftrightunsigned(_unit32(F.col("key")) * buckets, 32))

    counts = keyed.groupBy("skey", "bucket").agg(F.count("*").alias("n"))
    sources = counted.groupBy("skey").agg(F.sum("n").alias("source_rows"))
    first = rows_before(counts, ["skey"], "bucket").join(sources, "skey").select("skey", "bucket", "before", "source_rows")
    inside = F.row_number().over(Window.partitionBy("skey", "bucket").orderBy("key", "dkey", "copy"))
    ranked = keyed.withColumn("rank", inside - 1).join(first, ["skey", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    phase = (_unit32(F.md5(F.concat(F.lit(f"{seed}:"), "skey"))) + 0.5) / 4294967296.0
    ranked = ranked.withColumn("fraction", (F.col("rank") + phase) / F.col("source_rows"))
    ranked = ranked.withColumn("bucket", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("bigint"))
    ranked = ranked.drop("key", "before", "source_rows")

    first = rows_before(ranked.groupBy("bucket").agg(F.count("*").alias("n")), [], "bucket").select("bucket", "before")
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("fraction", "skey", "rank"))
    placed = ranked.withColumn("place", inside - 1).join(first, "bucket").withColumn("place", F.col("place") + F.col("before"))
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    placed = placed.withColumn("shard", shard.cast("int"))
    start = F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}")
    return placed.select(
        F.when(F.col("dkey") != "-", F.col("dkey").cast("bigint")).alias("doc_id"),
        *IDENTITY, "copy", "rank", "fraction", "shard", (F.col("place") - start).cast("bigint").alias("slot"),
    )


def shard_rows(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``row`` (a struct of all columns of ``df``), ``shard`` and ``slot``: the rows themselves in their places.

    Rows that repeat (equal in id, source, size and checksum) are pinned and numbered per partition first, so that one row repeated
    without end is spread over the tasks that read it."""
    mine = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), *_identity(df))
    repeated = checkpointed(mine.groupBy(*IDENTITY).agg(F.count("*").alias("n")).where("n > 1").select(*IDENTITY))
    single = mine.join(repeated, IDENTITY, "left_anti").withColumn("copy", F.lit(1).cast("bigint"))
    part = checkpointed(mine.join(repeated, IDENTITY, "left_semi").withColumn("part", F.spark_partition_id().cast("bigint")))
    before = rows_before(part.groupBy(*IDENTITY, "part").agg(F.count("*").alias("n")), IDENTITY, "part").select(*IDENTITY, "part", "before")
    inside = F.row_number().over(Window.partitionBy(*IDENTITY, "part").orderBy(F.xxhash64("row")))
    several = part.withColumn("copy", inside.cast("bigint")).join(before, [*IDENTITY, "part"])
    several = several.withColumn("copy", F.col("copy") + F.col("before")).drop("part", "before")
    places = assign_shards(df, shards, seed).select(*IDENTITY, "copy", "shard", "slot")
    return single.unionByName(several).join(places, [*IDENTITY, "copy"]).select("row", "shard", "slot")


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the rows as Parquet, one folder per shard, in the order of the slots (``slot``, ``row``). A shard is as many
    files as its rows need, each a range of slots."""
    placed = shard_rows(df, shards, seed).select("shard", "slot", "row")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return assign_shards(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )



OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text FROM documents
), c AS (SELECT *, {crc32_sql("text")} AS crc FROM d),
i AS (SELECT *, row_number() OVER (PARTITION BY skey, doc_id, size, crc) AS copy FROM c),
k AS (SELECT *, md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, '-'), size::VARCHAR, crc::VARCHAR, copy::VARCHAR)) AS key FROM i),
r AS (
  SELECT *, row_number() OVER (PARTITION BY skey ORDER BY key, doc_id, copy) - 1 AS rank, count(*) OVER (PARTITION BY skey) AS n,
         (('0x' || left(md5('{SEED}:' || skey), 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS phase FROM k
), p AS (SELECT *, row_number() OVER (ORDER BY (rank + phase) / n, skey, rank) - 1 AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, place * {SHARDS} // total AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(place - (shard * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s"""
