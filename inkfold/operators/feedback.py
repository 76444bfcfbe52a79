"""Search feedback: impressions, per-document statistics, attribution, training pairs, KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.operators.joins import left_join_sparse
from inkfold.operators.ordered import as_of


def normalize_feedback(events: DataFrame) -> DataFrame:
    """Event vocabulary (kind + rating) to the statistics vocabulary; other kinds are dropped."""
    kind = (
        F.when(F.col("kind") == "search_click", "click")
        .when((F.col("kind") == "search_rating") & (F.col("rating") == 1), "thumbs_up")
        .when((F.col("kind") == "search_rating") & (F.col("rating") == 0), "thumbs_down")
    )
    return events.withColumn("feedback_type", kind).where(F.col("feedback_type").isNotNull())


def impression_counts(sessions: DataFrame) -> DataFrame:
    """Sessions in which each document was shown; a repeat within one result list counts once."""
    shown = sessions.select(
        "session_id", F.explode(F.array_distinct("result_doc_ids")).alias("document_id")
    ).distinct()
    return shown.groupBy("document_id").agg(F.count("*").alias("total_impressions"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    kind = F.col("feedback_type")
    return feedback.groupBy("document_id").agg(
        F.count_if(kind == "thumbs_up").alias("thumbs_up"),
        F.count_if(kind == "thumbs_down").alias("thumbs_down"),
        F.count_if(kind == "click").alias("clicks"),
    )


def with_feedback_counts(impressions: DataFrame, counts: DataFrame) -> DataFrame:
    """Impressions with their feedback counts, 0 where there is none. Feedback on documents that
    were never shown has no impression row and falls away."""
    names = ["thumbs_up", "thumbs_down", "clicks"]
    return impressions.join(counts, "document_id", "left").select(
        "document_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], "total_impressions"
    )


def live_documents(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("deleted_at").isNull()).select("document_id")


def _unmarked(df: DataFrame, mark: str) -> DataFrame:
    return df.where(~F.coalesce(mark, F.lit(False))) if mark in df.columns else df


def document_feedback_stats(
    sessions: DataFrame,
    feedback: DataFrame,
    documents: DataFrame,
    computed_at: Column | None = None,
    exclude_test_accounts: bool = False,
) -> DataFrame:
    """Counts and up / down rates per live document that was shown at least once.

    ``exclude_test_accounts`` leaves out sessions and feedback marked ``is_test_account`` and documents
    marked ``is_test_doc``, where they carry these columns."""
    if exclude_test_accounts:
        sessions = _unmarked(sessions, "is_test_account")
        feedback = _unmarked(feedback, "is_test_account")
        documents = _unmarked(documents, "is_test_doc")
    impressions = impression_counts(sessions).where(F.col("document_id").isNotNull())
    live = impressions.join(live_documents(documents), "document_id", "left_semi")
    shown = F.col("total_impressions")

    def rate(name):
        return F.when(shown > 0, F.col(name) / shown).otherwise(F.lit(0.0))

    return with_feedback_counts(live, feedback_counts(feedback)).select(
        "*",
        rate("thumbs_up").alias("up_rate"),
        rate("thumbs_down").alias("down_rate"),
        (F.current_timestamp() if computed_at is None else computed_at).alias("computed_at"),
    )


def feedback_coverage(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("thumbs_up") > 0).alias("has_up"),
        F.count_if(F.col("thumbs_down") > 0).alias("has_down"),
    )


def top_documents_by_feedback(stats: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` documents with most ratings (ties by document id)."""
    return (
        stats.orderBy((F.col("thumbs_up") + F.col("thumbs_down")).desc(), "document_id")
        .limit(n)
        .select(
            "document_id", "thumbs_up", "thumbs_down", "clicks", "total_impressions",
            F.round("up_rate", 3).alias("up_rate"), F.round("down_rate", 3).alias("down_rate"),
        )
    )


def recent_feedback(feedback: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest feedback rows of each document, with their ``position``."""
    order = Window.partitionBy("document_id").orderBy(
        F.col("created_at").desc_nulls_last(), F.col("feedback_id").desc()
    )
    return feedback.withColumn("position", F.row_number().over(order)).where(
        F.col("position") <= n
    )


def recent_documents(documents: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` newest documents (ties: larger id first)."""
    return documents.orderBy(
        F.col("created").desc_nulls_last(), F.col("document_id").desc()
    ).limit(n)


def feedback_per_document(documents: DataFrame, feedback: DataFrame, n: int = 20) -> DataFrame:
    """Feedback count of the ``n`` newest documents. Only these documents' feedback is counted:
    the ``n``-row side is broadcast, so the feedback table is filtered where it is scanned."""
    newest = recent_documents(documents, n)
    wanted = F.broadcast(newest.select("document_id"))
    counts = (
        feedback.select("document_id")
        .join(wanted, "document_id", "left_semi")
        .groupBy("document_id")
        .agg(F.count("*").alias("feedback_count"))
    )
    return newest.join(counts, "document_id", "left").withColumn(
        "feedback_count", F.coalesce("feedback_count", F.lit(0))
    )


def attribute_feedback(
    queries: DataFrame, feedback: DataFrame, max_age_seconds: int = 1800
) -> DataFrame:
    """Attach to each feedback row the query it came from (``matched_query_id``, ``matched_by``).

    A feedback row that names a ``query_id`` takes that query if it exists. Otherwise it takes
    the newest query of its session that is not older than ``max_age_seconds``. Sessions are
    matched by an ordered as-of pass, never by pairing rows, because one session value
    ('anonymous') may hold a large share of both tables. Needs ``queries(query_id, session_id,
    ts)`` with unique query ids and ``feedback(feedback_id, session_id, query_id, ts)``."""
    named = queries.select("query_id", F.col("query_id").alias("_by_id"))
    marks = queries.select(
        "session_id", "ts", F.col("query_id").alias("_by_session"), F.col("ts").alias("_asked_at")
    )
    with_session = as_of(
        feedback, marks, ["session_id"], "ts", ["_by_session", "_asked_at"], ["_by_session"]
    )
    age = F.unix_micros("ts") - F.unix_micros("_asked_at")
    recent = F.when(age <= max_age_seconds * 1000000, F.col("_by_session"))
    return (
        left_join_sparse(with_session, named, "query_id", "feedback_id")
        .withColumn("matched_query_id", F.coalesce("_by_id", recent))
        .withColumn(
            "matched_by",
            F.when(F.col("_by_id").isNotNull(), "query_id").when(recent.isNotNull(), "session"),
        )
        .select(*feedback.columns, "matched_query_id", "matched_by")
    )


def retrieval_pairs(shown: DataFrame, feedback: DataFrame, chunks: DataFrame) -> DataFrame:
    """Query / chunk pairs with label 1 (document was clicked or rated up for the query) or 0
    (shown, neither clicked nor rated up).

    ``shown(query_id, query_text, document_id)``, ``feedback(query_id, document_id,
    feedback_type)``, ``chunks(query_id, document_id, chunk_index, score)`` = scored chunks of
    which the best per (query, document) is used."""
    liked = (
        feedback.where(F.col("feedback_type").isin("click", "thumbs_up"))
        .select("query_id", "document_id")
        .distinct()
        .withColumn("_liked", F.lit(1))
    )
    best = Window.partitionBy("query_id", "document_id").orderBy(
        F.col("score").desc(), "chunk_index"
    )
    top = (
        chunks.withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") == 1)
        .select("query_id", "document_id", "chunk_index", "score")
    )
    return (
        shown.select("query_id", "query_text", "document_id")
        .distinct()
        .join(liked, ["query_id", "document_id"], "left")
        .join(top, ["query_id", "document_id"])
        .select(
            "query_id", "query_text", "document_id", "chunk_index", "score",
            F.coalesce("_liked", F.lit(0)).alias("label"),
        )
    )


def kpi_columns() -> list[Column]:
    """Aggregates over events(kind, similarity, fallback): rates per window."""
    kind = F.col("kind")
    queries = F.count_if(kind == "query")
    requests = F.count_if(kind == "htr_request")
    clicks = F.count_if(kind == "click")
    corrections = F.count_if(kind == "correction")
    similarity = F.when(kind == "query", F.col("similarity"))
    fallbacks = F.count_if((kind == "query") & F.coalesce("fallback", F.lit(False)))
    return [
        queries.alias("queries"),
        clicks.alias("clicks"),
        requests.alias("requests"),
        corrections.alias("corrections"),
        F.try_divide(clicks, queries).alias("ctr"),
        F.try_divide(corrections, requests).alias("correction_rate"),
        F.try_divide(fallbacks, queries).alias("fallback_rate"),
        F.avg(similarity).alias("mean_similarity"),
        F.max(similarity).alias("max_similarity"),
    ]


def usage_kpis(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Click-through, correction and fallback rates and similarity per (sliding) time window.
    Only clicks count as click-through; ratings do not.

    In a batch a sliding window is put together from slide-wide buckets: the rows are counted once, and
    only the buckets are copied to the windows they lie in."""
    if slide and not events.isStreaming:
        return _sliding_kpis(events, width, slide)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        events.groupBy(window.alias("w"))
        .agg(*kpi_columns())
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*")
        .drop("w")
    )


def _sliding_kpis(events: DataFrame, width: str, slide: str) -> DataFrame:
    kind = F.col("kind")
    is_query = kind == "query"
    counts = {
        "queries": F.count_if(is_query), "clicks": F.count_if(kind == "click"), "requests": F.count_if(kind == "htr_request"),
        "corrections": F.count_if(kind == "correction"),
        "_fallbacks": F.count_if(is_query & F.coalesce("fallback", F.lit(False))),
        "_n": F.count(F.when(is_query, F.col("similarity"))), "_sum": F.sum(F.when(is_query, F.col("similarity"))),
        "_max": F.max(F.when(is_query, F.col("similarity"))),
    }
    buckets = events.groupBy(F.window("ts", slide)["start"].alias("_at")).agg(*[c.alias(n) for n, c in counts.items()])
    reach = F.expr(f"INTERVAL {width}")
    step = F.expr(f"INTERVAL {slide}")
    starts = F.sequence(F.col("_at") - reach + step, F.col("_at"), step)
    summed = (
        buckets.withColumn("window_start", F.explode(starts))
        .groupBy("window_start")
        .agg(*[F.max(n).alias(n) if n == "_max" else F.sum(n).alias(n) for n in counts])
    )
    return summed.select(
        "window_start", (F.col("window_start") + reach).alias("window_end"), "queries", "clicks", "requests", "corrections",
        F.try_divide("clicks", "queries").alias("ctr"),
        F.try_divide("corrections", "requests").alias("correction_rate"),
        F.try_divide("_fallbacks", "queries").alias("fallback_rate"),
        F.try_divide("_sum", "_n").alias("mean_similarity"),
        F.col("_max").alias("max_similarity"),
    )


def purge_expired(feedback: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Feedback that is still within its retention time. Rows without a time are kept: nothing says
    that theirs is over."""
    return feedback.where(F.col("created_at").isNull() | (F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS")))


def redact_events(
    events: DataFrame,
    test_documents: DataFrame | None = None,
    hashed: Sequence[str] = ("user_id", "session_id"),
    texts: Sequence[str] = ("query_text", "corrected_text"),
    salt: str = "",
) -> DataFrame:
    """Events without personal data: ids in ``hashed`` become salted SHA-256 digests (blank ids null), e-mail addresses
    and numbers of seven or more digits in ``texts`` become ``[email]`` and ``[number]``. Events of ``test_documents``
    (``doc_number``) go. Columns that are not there are passed over."""
    out = events
    if test_documents is not None and "doc_number" in events.columns:
        out = out.join(test_documents.select("doc_number").distinct(), "doc_number", "left_anti").select(*events.columns)
    changed = {}
    for name in hashed:
        if name in events.columns:
            plain = F.nullif(F.col(name).cast("string"), F.lit(""))
            changed[name] = F.sha2(F.encode(F.concat(F.lit(salt), plain), "UTF-8"), 256)
    for name in texts:
        if name in events.columns:
            no_mail = F.regexp_replace(name, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[email]")
            changed[name] = F.regexp_replace(no_mail, r"[0-9]{7,}", "[number]")
    return out.withColumns(changed)
