"""Upkeep of document and chunk tables, id mapping and request-log rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.operators.joins import left_join_sparse

# Request paths and the counters they feed (fixed values).
FEEDBACK_COUNTERS = {
    "/api/ml/htr/corrections/": "/metrics/correction-recorded",
    "/api/ml/search/feedback/": "/metrics/click-recorded",
}
# Columns that an upsert overwrites (fixed values).
UPDATED_FIELDS = ["page_count", "tesseract_text", "htr_text", "merged_text", "source"]


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row per key in ``order``; pruned to one row per key before the shuffle."""
    window = Window.partitionBy(key).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == 1).drop("_rank")
    )


def upsert_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Replace all chunks of every document that has new chunks; others stay untouched, and so
    does a document whose new text is empty (it has no new chunks)."""
    replaced = new.select("document_id").distinct()
    return existing.join(replaced, "document_id", "left_anti").unionByName(new)


def upsert_documents(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Insert or update by ``doc_number``. An update keeps id and filename and replaces the page
    count, the three texts and the source. ``updates`` carries ``updated_at``; the newest row per
    document wins."""
    newest = latest_per_key(
        updates,
        "doc_number",
        [F.col("updated_at").desc_nulls_last(), F.col("id").asc()],
    )
    old, new = existing.alias("old"), newest.alias("new")
    is_new = F.col("new.doc_number").isNotNull()
    is_old = F.col("old.doc_number").isNotNull()
    columns = []
    for name in existing.columns:
        if name == "doc_number":
            columns.append(F.coalesce("old.doc_number", "new.doc_number").alias(name))
        elif name in UPDATED_FIELDS:
            columns.append(
                F.when(is_new, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)
            )
        elif name in newest.columns:
            columns.append(
                F.when(is_old, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}")).alias(name)
            )
        else:
            columns.append(F.col(f"old.{name}").alias(name))
    return old.join(new, F.col("old.doc_number") == F.col("new.doc_number"), "full").select(*columns)


def newest_documents(rows: DataFrame) -> DataFrame:
    """Stored document versions -> one row per ``doc_number`` (with its ``_version``): the updated fields
    of the newest version, wherever it was stored; id, filename and the rest as first stored."""
    age = F.struct("_version", "batch")
    names = [c for c in rows.columns if c not in ("doc_number", "_version", "batch")]
    kept = [c for c in names if c not in UPDATED_FIELDS]
    updated = [c for c in names if c in UPDATED_FIELDS]
    one = rows.groupBy("doc_number").agg(
        F.min_by(F.struct(*kept), F.struct("batch", "_version")).alias("k"),
        F.max_by(F.struct(*updated), age).alias("u"),
        F.max("_version").alias("_version"),
    )
    fields = [F.col(f"{'u' if c in updated else 'k'}.{c}").alias(c) for c in names]
    return one.select("doc_number", *fields, "_version")


def newest_of(rows: DataFrame, key: str) -> DataFrame:
    """Of stored row sets, one per ``key`` and version, the rows of the newest version of each key (with
    ``_version``): what an update did not bring again is gone."""
    newest = rows.groupBy(key).agg(F.max(F.struct("_version", "batch")).alias("_newest"))
    same = (F.col("_version").eqNullSafe(F.col("_newest._version"))) & (F.col("batch") == F.col("_newest.batch"))
    return rows.join(newest, key).where(same).drop("_newest", "batch").select(*[c for c in rows.columns if c != "batch"])


def reprocess_guard(
    documents: DataFrame, pages: DataFrame, regions: DataFrame, corrections: DataFrame
) -> DataFrame:
    """Per document: number of corrections and whether it may be reprocessed. Corrections are
    counted per region first, so a hot document joins few rows."""
    per_region = corrections.groupBy("region_id").agg(F.count("*").alias("n"))
    per_document = (
        per_region.join(
            regions.select(F.col("id").alias("region_id"), "page_id"), "region_id"
        )
        .join(pages.select(F.col("id").alias("page_id"), "document_id"), "page_id")
        .groupBy("document_id")
        .agg(F.sum("n").alias("correction_count"))
    )
    count = F.coalesce("correction_count", F.lit(0))
    return (
        documents.select("document_id")
        .join(per_document, "document_id", "left")
        .select(
            "document_id",
            count.alias("correction_count"),
            F.when(count > 0, "skip").otherwise("reprocess").alias("action"),
        )
    )


def map_doc_ids(df: DataFrame, ids: DataFrame, column: str = "document_ref") -> DataFrame:
    """Add ``doc_number`` and ``doc_uuid`` for a reference that is an integer, a digit string or
    a uuid; both null where it is unmapped. ``ids(doc_number, doc_uuid)``."""
    ref = F.lower(F.col(column).cast("string"))
    by_number = ids.select(
        F.col("doc_number").cast("string").alias("_ref"), "doc_number", "doc_uuid"
    )
    by_uuid = ids.select(F.lower("doc_uuid").alias("_ref"), "doc_number", "doc_uuid")
    canonical = F.when(ref.rlike("^[0-9]+$"), F.regexp_replace(ref, "^0+(?=[0-9])", "")).otherwise(ref)
    return (
        df.withColumn("_ref", canonical).join(by_number.unionByName(by_uuid), "_ref", "left").drop("_ref")
    )


def rewrite_queue_ids(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """Queue groups with an integer id: a mapped group and each of its regions get
    ``document_id`` (integer as text), ``document_id_uuid`` and ``doc_number``; all their other fields
    stay. Unmapped groups and their regions keep their own values; the added fields are null."""
    mapped = groups.join(
        ids.select(F.col("doc_uuid").alias("document_id"), F.col("doc_number").alias("_n")),
        "document_id",
        "left",
    )
    number = F.col("_n")
    # Named before the final select, whose own document_id the lambda would otherwise pick up.
    named = mapped.withColumn("_uuid", F.when(number.isNotNull(), F.col("document_id"))).withColumn(
        "_text", number.cast("string")
    )
    fields = {f.name for f in groups.schema["regions"].dataType.elementType.fields}

    def region(r: Column) -> Column:
        own = r["document_id"] if "document_id" in fields else F.lit(None).cast("string")
        return (
            r.withField("document_id", F.coalesce(F.col("_text"), own))
            .withField("document_id_uuid", F.col("_uuid"))
            .withField("doc_number", number)
        )

    rewritten = named.withColumn("regions", F.transform("regions", region)).withColumns(
        {"document_id": F.coalesce("_text", "document_id"), "document_id_uuid": F.col("_uuid"), "doc_number": number}
    )
    return rewritten.drop("_uuid", "_text", "_n")


def rewrite_doc_paths(log: DataFrame, ids: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Add ``rewritten_path``: document paths with a mapped uuid get the integer id, all other
    paths stay as they are. ``row_id`` spreads the many lines without a document."""
    # Path of a document page (fixed value).
    pattern = r"^/api/documents/([0-9a-fA-F-]{36})(/.*)?$"
    uuid = F.lower(F.regexp_extract("path", pattern, 1))
    mapping = ids.select(F.lower("doc_uuid").alias("_uuid"), F.col("doc_number").alias("_n"))
    rest = F.regexp_extract("path", pattern, 2)
    rewritten = F.concat(F.lit("/api/documents/"), F.col("_n").cast("string"), rest)
    keyed = log.withColumn("_uuid", F.nullif(uuid, F.lit("")))
    return (
        left_join_sparse(keyed, mapping, "_uuid", row_id)
        .withColumn("rewritten_path", F.coalesce(rewritten, F.col("path")))
        .drop("_uuid", "_n")
    )


def successful_feedback_posts(log: DataFrame) -> DataFrame:
    """Successful posts to the feedback paths with the counter each one feeds."""
    counter = F.create_map(*[F.lit(v) for pair in FEEDBACK_COUNTERS.items() for v in pair])
    return log.where(
        (F.col("method") == "POST")
        & F.col("status").between(200, 299)
        & F.col("path").isin(*FEEDBACK_COUNTERS)
    ).withColumn("counter", counter[F.col("path")])


def merge_document_text(pages: DataFrame) -> DataFrame:
    """One row per document: page texts joined in page order. A page's merged text is its
    printed text followed by its handwritten text; blank parts are left out."""
    printed = F.nullif(F.coalesce("tesseract_text", F.lit("")), F.lit(""))
    written = F.nullif(F.coalesce("htr_text", F.lit("")), F.lit(""))
    page = F.struct("page_number", printed.alias("t"), written.alias("h"))
    # One list per document, as long as the document has pages.
    listed = pages.groupBy("document_id").agg(
        F.sort_array(F.collect_list(page)).alias("p"), F.count("*").alias("page_count")
    )
    merged = F.transform("p", lambda x: F.nullif(F.concat_ws("\n", x["t"], x["h"]), F.lit("")))
    return listed.select(
        "document_id",
        "page_count",
        F.array_join(F.col("p.t"), "\n").alias("tesseract_text"),
        F.array_join(F.col("p.h"), "\n").alias("htr_text"),
        F.array_join(merged, "\n").alias("merged_text"),
    )
