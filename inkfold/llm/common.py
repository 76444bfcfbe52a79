"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.session import tune

# Rows of one Arrow batch. Texts may hold megabytes, so a batch is kept short.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime options of the library, and short Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def keyed_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text; other columns, whatever their names, do not reach the operators."""
    return df.select(F.col(key).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))


def sha256_hex(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def per_worker(holder, key: str, build):
    """``build()``, kept in a broadcast dictionary: a worker process keeps its copy from task to task."""
    kept = holder.value
    if key not in kept:
        kept[key] = build()
    return kept[key]


# Copies of one row are numbered in blocks of so many, and bucket counts summed in groups of so many.
COPY_BLOCK, BUCKET_GROUP = 1024, 1024


def numbered_copies(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Expand rows (keys, n) to ``n`` rows each, numbered by ``copy`` from 1. A row that stands for many is split into
    blocks that are dealt out before they are expanded."""
    few = counted.where(F.col("n") <= COPY_BLOCK).select(*keys, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))
    last = F.expr(f"cast((n - 1) div {COPY_BLOCK} as bigint)")
    blocks = counted.where(F.col("n") > COPY_BLOCK).select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    begin = F.col("block") * COPY_BLOCK + 1
    spread = blocks.repartition(*keys, "block")
    many = spread.select(*keys, F.explode(F.sequence(begin, F.least(F.col("n"), begin + (COPY_BLOCK - 1)))).alias("copy"))
    return few.unionByName(many)


def rows_before(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Add ``before`` to ``counts`` (keys, bucket, n): the sum of ``n`` over the smaller buckets of the same keys. Sums go
    over groups of buckets first, so a task orders one group, or one row per group."""
    grouped = counts.withColumn("_group", F.floor(F.col(bucket) / BUCKET_GROUP))
    earlier = (Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_group").rowsBetween(*earlier)
    inner = Window.partitionBy(*keys, "_group").orderBy(bucket).rowsBetween(*earlier)
    zero = F.lit(0).cast("bigint")
    groups = grouped.groupBy(*keys, "_group").agg(F.sum("n").alias("_n"))
    groups = groups.select(*keys, "_group", F.coalesce(F.sum("_n").over(outer), zero).alias("_before"))
    inside = grouped.withColumn("_inside", F.coalesce(F.sum("n").over(inner), zero))
    return inside.join(groups, [*keys, "_group"]).withColumn("before", F.col("_before") + F.col("_inside")).drop("_group", "_before", "_inside")


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of a text's UTF-8 bytes: nibbles of its hexadecimal form, low ones first,
    with a table of 16 entries that follows from the polynomial."""
    entries = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        entries.append(value)
    nibbles = rf"string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\2\1', 'g'), '')"
    steps = f"list_prepend(4294967295, list_transform(list_filter({nibbles}, lambda x: x <> ''), lambda x: ('0x' || x)::BIGINT))"
    return f"xor(list_reduce({steps}, lambda c, x: xor(c >> 4, {entries}[1 + (xor(c, x) & 15)])), 4294967295)"
