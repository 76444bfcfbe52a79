"""Sinks: correction archive, snapshots with manifest, replaced stats, bucketed upserts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.operators.corrections import (
    archive_records,
    document_grouped_split,
    rows_to_shards,
    shard_counts,
    split_overlap,
    unarchived,
)
from inkfold.sources.readers import read_correction_archive


def write_correction_archive(
    corrections: DataFrame, path: str, archived_at: Column | None = None
) -> None:
    """Append the corrections the archive does not hold yet, many records per file.

    A dated correction always has the same partition, so only the partitions of the new rows' dates
    are searched for its id. One without a time goes to the day of its run; when there are such
    rows, the undated ones of the whole archive are searched too. Hot dates are split over several
    files by the rebalance hint."""
    spark = corrections.sparkSession
    # One instant for the whole run, also if a task is run again.
    now = F.lit(dt.datetime.now(dt.UTC)) if archived_at is None else archived_at
    rows = archive_records(corrections, now)
    undated = F.col("corrected_at").isNull()
    days = rows.groupBy("date").agg(F.max(undated).alias("undated")).collect()  # calendar days
    near = F.col("date").isin([d["date"] for d in days])
    if any(d["undated"] for d in days):
        near = near | undated
    held = read_correction_archive(spark, path).where(near)
    fresh = unarchived(rows.drop("archived_at"), held).withColumn(
        "archived_at", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    )
    fresh.select(*rows.columns).hint("rebalance", "date").write.mode("append").partitionBy(
        "date"
    ).json(path)


def snapshot_version(at: dt.datetime) -> str:
    return f"v_{at.astimezone(dt.UTC):%Y%m%d_%H%M%S}"


def write_snapshot(
    rows: DataFrame,
    path: str,
    version: str,
    order_by: list[str],
    shard_size: int = 500,
    shards_per_task: int = 200,
) -> DataFrame:
    """Write ``path/version/split=*/`` in shards of exactly ``shard_size`` rows in row order (the
    last of a split may be shorter; an empty split writes nothing). Returns rows per shard.

    Tasks get whole groups of shards, so file borders fall on shard borders. Prefer 100,000 or more
    rows per shard for large snapshots."""
    sharded = rows_to_shards(rows, order_by, shard_size)
    group = F.floor(F.col("shard_id") / shards_per_task)
    (
        sharded.repartition("split", group)
        .sortWithinPartitions("split", "row_index")
        .select(*rows.columns)
        .write.mode("error")
        .option("maxRecordsPerFile", shard_size)
        .partitionBy("split")
        .parquet(f"{path}/{version}")
    )
    return shard_counts(sharded)


def manifest(
    counts: DataFrame, version: str, created_at: str, report: DataFrame | None = None, val_fraction: float = 0.2,
    rows: DataFrame | None = None,
) -> DataFrame:
    """One-row manifest from the rows per shard and the quality report. With the snapshot's ``rows``
    (document_id, split) the leakage block holds what was found in them: documents in both splits, and
    rows whose split is not the one their document's hash gives."""
    measured = [
        ("documents_in_both_splits", F.lit(None).cast("bigint")),
        ("rows_against_split_rule", F.lit(None).cast("bigint")),
    ]
    if rows is not None:
        ruled = document_grouped_split(rows.select("document_id", F.col("split").alias("given")), val_fraction)
        wrong = ruled.agg(F.count_if(F.col("given") != F.col("split")).alias("n"))
        shared = split_overlap(rows).agg(F.count("*").alias("n"))
        measured = [("documents_in_both_splits", shared.scalar()), ("rows_against_split_rule", wrong.scalar())]
    found = F.array(*[F.struct(F.lit(n).alias("check"), v.alias("violations")) for n, v in measured])
    def of(split, column):
        return F.coalesce(F.sum(F.when(F.col("split") == split, column)), F.lit(0))

    size, one = F.col("rows"), F.lit(1)
    totals = counts.agg(
        F.struct(
            of("train", size).alias("train"),
            of("val", size).alias("val"),
            F.coalesce(F.sum(size), F.lit(0)).alias("total"),
        ).alias("counts"),
        F.struct(
            of("train", one).cast("int").alias("train"), of("val", one).cast("int").alias("val")
        ).alias("shards"),
    )
    out = totals.select(
        F.lit(version).alias("version"),
        F.lit(created_at).alias("created_at"),
        F.lit("htr_training_data").alias("pipeline"),
        F.struct(
            F.lit(True).alias("opted_in"),
            F.lit(True).alias("non_empty_text"),
            F.lit(True).alias("exclude_test_synthetic"),
            F.lit(True).alias("exclude_deleted"),
            F.lit("keep_latest").alias("dedup_by_region"),
        ).alias("candidate_selection"),
        F.struct(
            F.lit("document_grouped_hash").alias("split_method"),
            F.lit(val_fraction).alias("val_fraction"),
            F.lit("sha256(document_id) % 10000 / 10000").alias("hash_algorithm"),
            found.alias("invariants"),
        ).alias("leakage_prevention"),
        "counts",
        "shards",
    )
    if report is None:
        return out
    block = report.select(F.struct(*report.columns).alias("r"))
    return out.withColumn("data_quality", block.scalar())


def write_manifest(row: DataFrame, path: str, version: str) -> None:
    row.coalesce(1).write.mode("error").json(f"{path}/{version}/_manifest")


def replace_stats(stats: DataFrame, path: str, version: str) -> None:
    """Full replace: write a new version, then append a pointer to it. Readers follow the newest
    pointer and never see a half-written table."""
    stats.write.mode("error").parquet(f"{path}/data/{version}")
    pointer = stats.sparkSession.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("written_at")
    )
    pointer.coalesce(1).write.mode("append").json(f"{path}/current")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    newest = (
        spark.read.schema("version STRING, written_at TIMESTAMP")
        .json(f"{path}/current")
        .agg(F.max_by("version", "written_at").alias("version"))
        .first()
    )
    return spark.read.parquet(f"{path}/data/{newest['version']}")


def append_version(rows: DataFrame, path: str, batch_id: int, version: Column) -> None:
    """Store a micro-batch's own rows, with their ``version`` time, in a folder of their own. Nothing
    that is there is read or rewritten; a repeated batch replaces itself."""
    rows.withColumn("_version", version.cast("timestamp")).write.mode("overwrite").parquet(
        f"{path}/batches/batch={batch_id}"
    )


def read_versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All stored rows with ``_version`` and ``batch``: the newest compacted base (batch -1) and the
    batches after it. Empty where nothing is stored yet."""
    full = f"{schema}, _version TIMESTAMP"
    base, upto = None, -1
    pointer = _read_or_none(spark.read.schema("base STRING, upto BIGINT, written_at TIMESTAMP").json, f"{path}/current")
    if pointer is not None:
        newest = pointer.agg(F.max_by(F.struct("base", "upto"), "written_at").alias("p")).first()["p"]
        base, upto = newest["base"], newest["upto"]
    batches = _read_or_none(spark.read.schema(f"{full}, batch BIGINT").parquet, f"{path}/batches")
    if batches is None:
        batches = spark.createDataFrame([], f"{full}, batch BIGINT")
    rows = batches.where(F.col("batch") > upto)
    if base is not None:
        stored = spark.read.schema(full).parquet(f"{path}/base/{base}")
        rows = rows.unionByName(stored.withColumn("batch", F.lit(-1).cast("bigint")))
    return rows


def _read_or_none(read: Callable[[str], DataFrame], path: str) -> DataFrame | None:
    try:
        return read(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def compact_versions(
    spark: SparkSession, path: str, schema: str, resolve: Callable[[DataFrame], DataFrame], name: str
) -> None:
    """Write the resolved rows (with ``_version``) as a new base and append a pointer to it. Readers
    follow the newest pointer; batches stored meanwhile stay after the base."""
    rows = read_versions(spark, path, schema)
    upto = rows.agg(F.max("batch")).first()[0]
    if upto is None:
        return
    resolve(rows.where(F.col("batch") <= upto)).write.mode("error").parquet(f"{path}/base/{name}")
    pointer = spark.range(1).select(
        F.lit(name).alias("base"), F.lit(upto).alias("upto"), F.current_timestamp().alias("written_at")
    )
    pointer.coalesce(1).write.mode("append").json(f"{path}/current")
