"""Correction pipeline: archive, eligibility, newest per region, quality gate, split, snapshot."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.text import (
    SPLIT_BUCKETS,
    date_of,
    iso_offset,
    normalize_user,
    parse_s3_uri,
    py_strip,
    split_bucket,
)
from inkfold.session import checkpointed

# Rejection codes in order of evaluation (fixed values).
REJECTION_CODES = [
    "R1_no_op_correction",
    "R2_empty_after_strip",
    "R3_crop_url_invalid",
    "R4_crop_missing_in_minio",
    "R5_correction_too_long",
]
ARCHIVE_VERSION = "v1"


def denormalize_corrections(
    corrections: DataFrame, regions: DataFrame, pages: DataFrame, documents: DataFrame
) -> DataFrame:
    """Correction with its region's crop and output and its document id (all inner joins)."""
    r = regions.select(
        F.col("id").alias("region_id"), "page_id", "crop_s3_url",
        F.col("htr_output").alias("original_text"),
    )
    p = pages.select(F.col("id").alias("page_id"), "document_id")
    d = documents.select(F.col("id").alias("document_id"))
    return (
        corrections.withColumnRenamed("id", "correction_id")
        .join(r, "region_id")
        .join(p, "page_id")
        .join(d, "document_id")
        .select(
            "correction_id", "region_id", "document_id", "original_text", "corrected_text",
            "opted_in", "user_id", "corrected_at", "crop_s3_url", "archived_at",
        )
    )


def unarchived(corrections: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """Corrections not archived yet: by their own mark, and by absence from ``archive`` when the
    source cannot be marked."""
    rows = corrections
    if "archived_at" in corrections.columns:
        rows = rows.where(F.col("archived_at").isNull())
    if archive is not None:
        rows = rows.join(archive.select("correction_id"), "correction_id", "left_anti")
    return rows


def archive_records(corrections: DataFrame, archived_at: Column) -> DataFrame:
    """The archive form of denormalised corrections, with its ``date`` partition column.
    One ``archived_at`` is shared by the whole run."""
    stamp = F.coalesce(F.col("corrected_at"), archived_at)
    return corrections.select(
        F.col("correction_id").cast("string").alias("correction_id"),
        F.col("region_id").cast("string").alias("region_id"),
        F.col("document_id").cast("string").alias("document_id"),
        F.coalesce("original_text", F.lit("")).alias("original_text"),
        F.coalesce("corrected_text", F.lit("")).alias("corrected_text"),
        F.coalesce("opted_in", F.lit(False)).alias("opted_in"),
        normalize_user("user_id").alias("user_id"),
        iso_offset("corrected_at").alias("corrected_at"),
        "crop_s3_url",
        iso_offset(archived_at).alias("archived_at"),
        F.lit(ARCHIVE_VERSION).alias("archive_version"),
        date_of(stamp).alias("date"),
    )


def archive_report(archive: DataFrame) -> DataFrame:
    """Corrections per date partition ('unknown' where absent) and a 'total' row."""
    dated = archive.select(F.coalesce(F.col("date").cast("string"), F.lit("unknown")).alias("date"))
    return (
        dated.rollup("date")
        .agg(F.count("*").alias("corrections"))
        .select(F.coalesce("date", F.lit("total")).alias("date"), "corrections")
    )


def live_uploads(documents: DataFrame) -> DataFrame:
    """Ids of documents that may feed training now: user uploads that are not soft-deleted."""
    return documents.where(
        (F.col("source") == "user_upload") & F.col("deleted_at").isNull()
    ).select("document_id")


def eligible_corrections(archive: DataFrame, documents: DataFrame) -> DataFrame:
    """Opted-in, non-blank corrections of live uploads. Where the archive carries
    ``excluded_from_training``, rows with that mark are left out as well."""
    rows = archive.where(
        F.coalesce("opted_in", F.lit(False))
        & (py_strip(F.coalesce("corrected_text", F.lit(""))) != "")
    )
    if "excluded_from_training" in archive.columns:
        rows = rows.where(~F.coalesce("excluded_from_training", F.lit(False)))
    return rows.join(live_uploads(documents), "document_id", "left_semi")


def latest_per_region(corrections: DataFrame) -> DataFrame:
    """The newest correction of each region; ties go to the smaller correction id. Spark prunes
    to one row per region before the shuffle, so a hot region moves one row per task."""
    order = Window.partitionBy("region_id").orderBy(
        F.col("corrected_at").desc_nulls_last(), F.col("correction_id").asc()
    )
    return (
        corrections.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def ordered_candidates(corrections: DataFrame) -> DataFrame:
    """Candidates by ``corrected_at`` ascending (missing first): one range-partitioned sort."""
    return corrections.orderBy(F.col("corrected_at").asc_nulls_first(), "correction_id")


def quality_reasons(
    candidates: DataFrame, crops: DataFrame | None = None, max_growth: int = 10
) -> DataFrame:
    """Add ``reason``: the first rejection code that applies, null for accepted rows.

    ``crops`` lists the existing crop objects (``crop_s3_url``); without it R4 is not evaluated.
    R5 rejects texts longer than ``max_growth`` times the original."""
    corrected = F.coalesce("corrected_text", F.lit(""))
    original = F.coalesce("original_text", F.lit(""))
    rows = candidates
    missing = F.lit(False)
    if crops is not None:
        listed = crops.select("crop_s3_url").distinct().withColumn("_listed", F.lit(True))
        rows = rows.join(listed, "crop_s3_url", "left")
        missing = F.col("_listed").isNull()
    limit = F.greatest(F.char_length(original), F.lit(1)) * max_growth
    checks = [
        corrected == original,
        py_strip(corrected) == "",
        parse_s3_uri("crop_s3_url").isNull(),
        missing,
        F.char_length(corrected) > limit,
    ]
    reason = F.lit(None).cast("string")
    for code, check in reversed(list(zip(REJECTION_CODES, checks, strict=True))):
        reason = F.when(check, F.lit(code)).otherwise(reason)
    return rows.withColumn("reason", reason).select(*candidates.columns, "reason")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNull()).drop("reason")


def rejection_samples(judged: DataFrame, samples: int = 2) -> DataFrame:
    """The first ``samples`` rejected rows per reason, in correction id order."""
    order = Window.partitionBy("reason").orderBy("correction_id")
    return (
        judged.where(F.col("reason").isNotNull())
        .withColumn("sample_no", F.row_number().over(order))
        .where(F.col("sample_no") <= samples)
        .select(
            "reason", "sample_no", "correction_id", "region_id", "crop_s3_url", "original_text",
            "corrected_text",
        )
    )


def quality_report(judged: DataFrame, samples: int = 2) -> DataFrame:
    """One row: totals, rejections per reason and sample rows per reason, as the manifest has
    them. The collected lists hold at most ``samples`` rows per reason. The judged rows are pinned, so
    that what made them runs once for both."""
    fields = ["correction_id", "region_id", "crop_s3_url", "original_text", "corrected_text"]
    judged = checkpointed(judged.select("reason", *fields))
    counts = judged.groupBy("reason").agg(F.count("*").alias("n"))
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_candidates"),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias(
            "rejected"
        ),
        F.map_from_entries(
            F.sort_array(
                F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))
            )
        ).alias("rejection_counts"),
    )
    listed = (
        rejection_samples(judged, samples)
        .select(
            "reason",
            F.struct("sample_no", *[F.col(f).cast("string").alias(f) for f in fields]).alias("s"),
        )
        .groupBy("reason")
        .agg(F.sort_array(F.collect_list("s")).alias("rows"))
        .select(
            "reason",
            F.transform("rows", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("rows"),
        )
    )
    examples = listed.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "rows")))).alias("m")
    )
    return totals.select("*", examples.scalar().alias("rejection_samples"))


def document_grouped_split(df: DataFrame, val_fraction: float = 0.2) -> DataFrame:
    """Add ``split``: 'val' for a fixed hash share of the documents, else 'train'. A document
    always lands in the same split, however often and in whatever order this runs."""
    share = split_bucket("document_id") / F.lit(float(SPLIT_BUCKETS))
    return df.withColumn("split", F.when(share < F.lit(val_fraction), "val").otherwise("train"))


def split_overlap(df: DataFrame) -> DataFrame:
    """Documents found in both splits (must be none)."""
    train = df.where(F.col("split") == "train").select("document_id")
    val = df.where(F.col("split") == "val").select("document_id")
    return train.intersect(val)


def split_counts(df: DataFrame) -> DataFrame:
    """Rows and documents per split, and how many documents lie in more than one split."""
    names = ("train", "val")
    per_document = df.groupBy("document_id").agg(*[F.count_if(F.col("split") == n).alias(n) for n in names])
    shared = F.count_if((F.col("train") > 0) & (F.col("val") > 0))
    totals = [
        F.struct(
            F.lit(n).alias("split"), F.sum(n).alias("corrections"), F.count_if(F.col(n) > 0).alias("documents"),
            shared.alias("overlap"),
        )
        for n in names
    ]
    return per_document.agg(F.array(*totals).alias("t")).select(F.explode("t").alias("s")).select("s.*").where("documents > 0")


def snapshot_projection(df: DataFrame) -> DataFrame:
    """The eight text columns of a training snapshot (needs ``split``). ``corrected_at`` may be a
    timestamp or ISO text."""
    is_text = dict(df.dtypes)["corrected_at"] == "string"
    day = F.substring("corrected_at", 1, 10) if is_text else date_of("corrected_at")
    return df.select(
        F.col("region_id").cast("string").alias("region_id"),
        "crop_s3_url",
        "corrected_text",
        F.coalesce("original_text", F.lit("")).alias("original_text"),
        F.lit("user_correction").alias("source"),
        "split",
        day.alias("correction_date"),
        F.coalesce(normalize_user("user_id"), F.lit("unknown")).alias("writer_id"),
    )


def rows_to_shards(
    df: DataFrame,
    order_by: list[str],
    shard_size: int = 500,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``row_index`` and ``shard_id`` (0-based, per split) in ``order_by`` order.

    The rows are range-sorted into balanced partitions and pinned by a checkpoint; positions then
    follow from the row counts of the partitions (a table of partitions x splits rows). No task
    sees more than its own range, whatever the order columns' skew."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["split", *order_by]
    pinned = checkpointed(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = pinned.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("_part", "split").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first")
    )
    before = (
        Window.partitionBy("split").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = runs.select(
        "_part", "split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    # At most partitions x splits rows, so the size of this broadcast does not grow with the data.
    return (
        placed.join(F.broadcast(offsets), ["_part", "split"])
        .withColumn("row_index", F.col("_offset") + F.col("_at") - F.col("_first"))
        .withColumn("shard_id", F.floor(F.col("row_index") / shard_size).cast("bigint"))
        .select(*df.columns, "row_index", "shard_id")
    )


def shard_counts(sharded: DataFrame) -> DataFrame:
    """Rows per (split, shard)."""
    return sharded.groupBy("split", "shard_id").agg(F.count("*").alias("rows"))


def training_text_rows(lines: DataFrame, is_decodable: Column | None = None) -> DataFrame:
    """Line images usable for training: decodable image and non-blank transcription. A bad row
    is dropped as a whole, so images and labels stay aligned."""
    decodable = F.col("image_png").isNotNull() if is_decodable is None else is_decodable
    text = py_strip(F.coalesce("transcription", F.lit("")))
    return lines.where(decodable & (text != "")).withColumn("transcription", text)


def truncate_labels(lines: DataFrame, tokenizer, max_tokens: int = 128) -> DataFrame:
    """Add ``label_ids``: the first ``max_tokens`` token ids of the transcription. ``tokenizer``
    is a picklable function from a list of texts to a list of id lists."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([list(t)[:max_tokens] for t in tokenizer(texts.tolist())])

    return lines.withColumn("label_ids", ids("transcription"))


def training_set(base: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    """Base lines plus the newest correction snapshot; the base alone when there is none."""
    tagged = base.withColumn("source", F.lit("base"))
    if snapshot is None:
        return tagged
    added = snapshot.select(
        F.col("region_id").alias("image_id"),
        "crop_s3_url",
        F.col("corrected_text").alias("transcription"),
        "split",
        "source",
    )
    return tagged.unionByName(added, allowMissingColumns=True)
