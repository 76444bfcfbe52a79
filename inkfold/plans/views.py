"""Derived inputs: the driver's tables brought into the shapes the operators read.

Each view is a whole-table projection or join of the given tables. ``SQL`` holds the same views
for the independent check."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.operators.ordered import running_count
from inkfold.session import tune

SERVICES = 3
MODELS = 4


class Tables:
    """Lazily built views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def document_count(self) -> int:
        """Number of documents, answered from the Parquet footers."""
        return self.table("documents").count()

    @cached_property
    def docs(self) -> DataFrame:
        kind = F.col("doc_id") % 10
        return self.documents.select(
            F.col("doc_id").alias("document_id"),
            "text",
            "lang",
            F.when(kind < 8, "user_upload").when(kind == 8, "synthetic").otherwise("test").alias("source"),
            F.when(F.col("doc_id") % 13 == 0, F.lit("2024-01-15").cast("timestamp")).alias("deleted_at"),
        )

    @cached_property
    def doc_ids(self) -> DataFrame:
        """Integer and uuid-shaped id of every document."""
        h = F.md5(F.col("doc_id").cast("string"))
        uuid = F.concat_ws(
            "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
            F.substring(h, 17, 4), F.substring(h, 21, 12),
        )
        return self.documents.select(F.col("doc_id").alias("doc_number"), uuid.alias("doc_uuid"))

    @cached_property
    def pages(self) -> DataFrame:
        """Two pages per document, each with half of its lines."""
        lines = F.split("text", "\n")
        half = F.ceil(F.size(lines) / 2).cast("int")
        first = F.array_join(F.slice(lines, F.lit(1), half), "\n")
        second = F.array_join(F.slice(lines, half + 1, F.size(lines)), "\n")
        rows = F.array(
            F.struct(F.lit(1).alias("no"), first.alias("t")),
            F.struct(F.lit(2).alias("no"), second.alias("t")),
        )
        return self.documents.select("doc_id", F.explode(rows).alias("p")).select(
            (F.col("doc_id") * 2 + F.col("p.no") - 1).alias("id"),
            F.col("doc_id").alias("document_id"),
            F.col("p.no").alias("page_number"),
            F.col("p.t").alias("tesseract_text"),
            F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("note "), F.col("doc_id").cast("string"))).alias("htr_text"),
        )

    @cached_property
    def regions(self) -> DataFrame:
        """Four regions per document; a region's output is one whole line of the text."""
        lines = F.split("text", "\n")
        crop = F.concat(
            F.lit("s3://images/documents/"), F.col("doc_id").cast("string"), F.lit("/regions/"),
            (F.col("doc_id") * 4 + F.col("k")).cast("string"), F.lit(".png"),
        )
        return self.documents.select(
            "doc_id", lines.alias("lines"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
        ).select(
            (F.col("doc_id") * 4 + F.col("k")).alias("id"),
            (F.col("doc_id") * 2 + F.floor(F.col("k") / 2)).alias("page_id"),
            F.when((F.col("doc_id") * 4 + F.col("k")) % 17 == 0, "http://bad").otherwise(crop).alias("crop_s3_url"),
            F.col("lines")[(F.col("k") % F.size("lines")).cast("int")].alias("htr_output"),
        )

    @cached_property
    def htr_corrections(self) -> DataFrame:
        """Corrections table: signups, spread over a third of the documents."""
        spread = F.lit(max(self.document_count // 3, 1))
        base = self.events.where(F.col("event_type") == "signup").select(
            F.col("event_id").alias("id"),
            (((F.col("event_id") * 7919) % spread) * 4 + F.col("event_id") % 4).alias("region_id"),
            (F.col("value") >= 20).alias("opted_in"),
            "user_id",
            F.col("ts").alias("corrected_at"),
            F.when(F.col("event_id") % 11 == 0, F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("archived_at"),
        )
        output = self.regions.select(F.col("id").alias("region_id"), "htr_output")
        kind = F.col("id") % 6
        corrected = (
            F.when(kind == 0, F.col("htr_output"))
            .when(kind == 1, "   ")
            .when(kind == 2, F.expr("repeat(concat(htr_output, 'x'), 12)"))
            .otherwise(F.concat(F.col("htr_output"), F.lit("!")))
        )
        return base.join(output, "region_id").select(
            "id", "region_id", corrected.alias("corrected_text"), "opted_in", "user_id",
            "corrected_at", "archived_at",
        )

    @cached_property
    def corrections(self) -> DataFrame:
        from inkfold.operators.corrections import denormalize_corrections

        return denormalize_corrections(
            self.htr_corrections, self.regions, self.pages, self.docs.withColumnRenamed("document_id", "id")
        )

    @cached_property
    def crops(self) -> DataFrame:
        """Crop objects that exist: those of one language never arrived."""
        owner = F.floor(F.col("id") / 4).alias("document_id")
        present = self.docs.where(F.col("lang") != "de").select("document_id")
        return self.regions.select("crop_s3_url", owner).join(present, "document_id", "left_semi").select("crop_s3_url")

    @cached_property
    def sessions(self) -> DataFrame:
        n = self.document_count
        e = F.col("event_id") * 31
        shown = F.array(e % n, (e + 97) % n, (e + 194) % n, (e + 291) % n, e % n)
        return self.events.where(F.col("event_type") == "view").select(
            F.col("event_id").alias("session_id"), "user_id", "ts", shown.alias("result_doc_ids")
        )

    @cached_property
    def acl(self) -> DataFrame:
        """Who may see which document: every event grants its user a run of ten documents."""
        first = F.col("event_id") * 7 % self.document_count
        runs = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (first + k * 13) % self.document_count)
        return self.events.select("user_id", F.explode(runs).alias("document_id")).distinct()

    @cached_property
    def feedback_events(self) -> DataFrame:
        """Feedback in the event vocabulary, kind + rating."""
        kind = F.col("event_type")
        return self.events.select(
            F.col("event_id").alias("feedback_id"),
            "user_id",
            "ts",
            ((F.col("event_id") * 31) % self.document_count).alias("document_id"),
            F.when(kind == "click", "search_click").when(kind == "signup", "htr_correction")
            .when(kind == "view", "other").otherwise("search_rating").alias("kind"),
            F.when(kind == "purchase", 1).when(kind == "error", 0).alias("rating"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        from inkfold.operators.feedback import normalize_feedback

        return normalize_feedback(self.feedback_events).drop("kind", "rating")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("point_key"),
            F.floor(F.col("vec_id") / 5).alias("document_id"),
            (F.col("vec_id") % 5).alias("chunk_index"),
            F.col("embedding").alias("vector"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        """Every embedding as a query, with a user, a session and a keyword result list."""
        n = self.document_count
        v = F.col("vec_id")
        return self.table("embeddings").select(
            v.alias("query_id"),
            (v % 150).alias("user_id"),
            v.cast("string").alias("session_id"),
            F.concat(F.lit("query "), v.cast("string")).alias("query_text"),
            F.array(F.floor(v / 5), (v * 31 + 1) % n).alias("keyword_ids"),
            F.col("embedding").alias("vector"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        failed = (F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)
        return self.events.select(
            F.col("event_type").alias("endpoint"),
            (F.col("user_id") % 4).alias("concurrency"),
            F.col("ts").alias("started_at"),
            F.col("value").alias("latency_ms"),
            F.when(failed, 500).otherwise(200).alias("status"),
        )

    @cached_property
    def tokens(self) -> DataFrame:
        return self.events.select(
            F.col("user_id").alias("region_id"), F.col("event_id").alias("step"), (F.col("value") / 500).alias("p")
        )

    @cached_property
    def samples(self) -> DataFrame:
        """A counter per event type that restarts at every thousandth event."""
        return self.events.select(
            "ts",
            F.col("event_type").alias("metric"),
            F.concat(F.lit("svc"), (F.col("user_id") % SERVICES).cast("string")).alias("service"),
            F.col("event_type").alias("series"),
            (F.col("event_id") % 1000).cast("double").alias("value"),
        )

    @cached_property
    def alias_log(self) -> DataFrame:
        """Promotions: purchases, one model per user group, versions counted up."""
        named = self.events.where(F.col("event_type") == "purchase").withColumn(
            "model", F.concat(F.lit("model"), (F.col("user_id") % MODELS).cast("string"))
        )
        return running_count(named, ["model"], "ts", "version", ["event_id"]).select(
            "model", "ts", "version"
        )

    @cached_property
    def model_events(self) -> DataFrame:
        return self.events.select(
            "event_id", "event_type", "ts", F.concat(F.lit("model"), (F.col("user_id") % MODELS).cast("string")).alias("model")
        )

    @cached_property
    def kpi_events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events.select(
            "ts",
            F.when(kind == "view", "query").when(kind == "click", "click").when(kind == "signup", "correction")
            .when(kind == "purchase", "htr_request").otherwise("rating").alias("kind"),
            (F.col("value") / 491).alias("similarity"),
            (F.col("value") < 200).alias("fallback"),
        )

    @cached_property
    def request_log(self) -> DataFrame:
        """Access-log lines: document pages by uuid, feedback posts, other paths."""
        h = self.doc_ids.withColumnRenamed("doc_number", "_d")
        target = (F.col("event_id") * 31) % (self.document_count + 50)
        rows = self.events.select("event_id", "event_type", target.alias("_d"), "value")
        kind = F.col("event_type")
        known = F.upper("doc_uuid")
        path = (
            F.when(kind == "view", F.concat(F.lit("/api/documents/"), F.coalesce(known, F.lit("00000000-0000-0000-0000-00000000000f")), F.lit("/preview/")))
            .when(kind == "click", "/api/ml/search/feedback/")
            .when(kind == "signup", "/api/ml/htr/corrections/")
            .otherwise("/api/tags/")
        )
        return rows.join(h, "_d", "left").select(
            "event_id",
            F.when(kind == "view", "GET").otherwise("POST").alias("method"),
            path.alias("path"),
            F.when(F.col("event_id") % 7 == 0, 403).otherwise(201).alias("status"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        """Alert notifications: errors as firing rollback alerts, others as other kinds."""
        kind = F.col("event_type")
        name = F.concat(F.lit("alert"), (F.col("event_id") % 3).cast("string"))
        trigger = F.when(kind.isin("error", "click"), "true").otherwise("false")
        return self.events.select(
            F.col("event_id").alias("alert_id"),
            F.concat(F.lit("model"), (F.col("user_id") % MODELS).cast("string")).alias("model"),
            F.col("ts").alias("received_at"),
            F.when(kind == "view", "resolved").otherwise("firing").alias("status"),
            F.create_map(F.lit("alertname"), name, F.lit("rollback_trigger"), trigger).alias("labels"),
        )


# The same views for the independent check. {name} of another view is resolved by ``with_views``.
SQL = {
    "v_docs": """
SELECT doc_id AS document_id, text, lang,
       CASE WHEN doc_id % 10 < 8 THEN 'user_upload' WHEN doc_id % 10 = 8 THEN 'synthetic' ELSE 'test' END AS source,
       CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '2024-01-15' END AS deleted_at
FROM documents""",
    "v_ids": """
SELECT doc_id AS doc_number, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS doc_uuid
FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)""",
    "v_pages": """
SELECT doc_id * 2 + no - 1 AS id, doc_id AS document_id, no AS page_number,
       CASE WHEN no = 1 THEN array_to_string(lines[1:half], chr(10)) ELSE array_to_string(lines[half + 1:], chr(10)) END AS tesseract_text,
       CASE WHEN doc_id % 3 = 0 THEN 'note ' || doc_id END AS htr_text
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, CAST(ceil(len(string_split(text, chr(10))) / 2) AS INTEGER) AS half FROM documents),
     (VALUES (1), (2)) AS p(no)""",
    "v_regions": """
SELECT doc_id * 4 + k AS id, doc_id * 2 + k // 2 AS page_id, doc_id AS document_id,
       CASE WHEN (doc_id * 4 + k) % 17 = 0 THEN 'http://bad'
            ELSE concat('s3://images/documents/', doc_id, '/regions/', doc_id * 4 + k, '.png') END AS crop_s3_url,
       lines[1 + k % len(lines)] AS htr_output
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), (VALUES (0), (1), (2), (3)) AS r(k)""",
    "v_htr": """
SELECT c.id, c.region_id, r.document_id,
       CASE c.id % 6 WHEN 0 THEN r.htr_output WHEN 1 THEN '   ' WHEN 2 THEN repeat(concat(r.htr_output, 'x'), 12)
            ELSE concat(r.htr_output, '!') END AS corrected_text,
       c.opted_in, c.user_id, c.corrected_at, c.archived_at, r.crop_s3_url, r.htr_output AS original_text
FROM (SELECT event_id AS id,
             ((event_id * 7919) % greatest((SELECT count(*) FROM documents) // 3, 1)) * 4 + event_id % 4 AS region_id,
             value >= 20 AS opted_in, user_id, ts AS corrected_at,
             CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL 15 MINUTE END AS archived_at
      FROM events WHERE event_type = 'signup') c
JOIN v_regions r ON r.id = c.region_id""",
    "v_corrections": """
SELECT id AS correction_id, region_id, document_id, original_text, corrected_text, opted_in, user_id, corrected_at,
       crop_s3_url, archived_at FROM v_htr""",
    "v_eligible": """
SELECT c.* FROM v_corrections c JOIN v_docs d USING (document_id)
WHERE c.opted_in AND trim(c.corrected_text) <> '' AND d.source = 'user_upload' AND d.deleted_at IS NULL""",
    "v_latest": """
SELECT * FROM v_eligible
QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY corrected_at DESC NULLS LAST, correction_id) = 1""",
    "v_crops": "SELECT crop_s3_url FROM v_regions JOIN v_docs USING (document_id) WHERE lang <> 'de'",
    "v_judged": """
SELECT l.*, CASE WHEN corrected_text = original_text THEN 'R1_no_op_correction'
                 WHEN trim(corrected_text) = '' THEN 'R2_empty_after_strip'
                 WHEN NOT regexp_matches(crop_s3_url, '^s3://[^/]+') THEN 'R3_crop_url_invalid'
                 WHEN crop_s3_url NOT IN (SELECT crop_s3_url FROM v_crops) THEN 'R4_crop_missing_in_minio'
                 WHEN length(corrected_text) > 10 * greatest(length(original_text), 1) THEN 'R5_correction_too_long'
            END AS reason
FROM v_corrections l""",
    "v_buckets": """
SELECT doc_id AS document_id, CAST((""" + " + ".join(
        f"(CAST('0x' || h[{1 + 8 * i}:{8 + 8 * i}] AS BIGINT) % 10000) * {pow(16, 8 * (7 - i), 10000)}" for i in range(8)
    ) + """) % 10000 AS BIGINT) AS bucket
FROM (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents)""",
    "v_split": """
SELECT l.*, CASE WHEN bucket / 10000.0 < 0.2 THEN 'val' ELSE 'train' END AS split
FROM v_latest l JOIN v_buckets USING (document_id)
WHERE correction_id IN (SELECT correction_id FROM v_judged WHERE reason IS NULL)""",
    "v_cer": """
SELECT split, corrected_text AS reference,
       CASE region_id % 4 WHEN 0 THEN replace(original_text, 'an', 'nae') WHEN 1 THEN 'x' || substring(original_text, 2)
            WHEN 2 THEN substring(original_text, 1, 20) || substring(original_text, 24) ELSE replace(original_text, 'é', 'è') END AS hypothesis
FROM v_split""",
    "v_sessions": """
SELECT event_id AS session_id, user_id, ts,
       list_value((event_id * 31) % n, (event_id * 31 + 97) % n, (event_id * 31 + 194) % n, (event_id * 31 + 291) % n, (event_id * 31) % n) AS result_doc_ids
FROM events, (SELECT count(*) AS n FROM documents) WHERE event_type = 'view'""",
    "v_feedback": """
SELECT event_id AS feedback_id, user_id, ts, (event_id * 31) % n AS document_id,
       CASE event_type WHEN 'purchase' THEN 'thumbs_up' WHEN 'error' THEN 'thumbs_down' ELSE 'click' END AS feedback_type
FROM events, (SELECT count(*) AS n FROM documents) WHERE event_type IN ('purchase', 'error', 'click')""",
    "v_acl": """
SELECT DISTINCT user_id, (event_id * 7 % n + k * 13) % n AS document_id
FROM events, (SELECT count(*) AS n FROM documents), range(10) AS r(k)""",
    "v_impressions": """
SELECT document_id, count(*) AS total_impressions
FROM (SELECT DISTINCT session_id, unnest(result_doc_ids) AS document_id FROM v_sessions) GROUP BY document_id""",
    "v_counts": """
SELECT document_id, count(*) FILTER (feedback_type = 'thumbs_up') AS thumbs_up,
       count(*) FILTER (feedback_type = 'thumbs_down') AS thumbs_down, count(*) FILTER (feedback_type = 'click') AS clicks
FROM v_feedback GROUP BY document_id""",
    "v_stats": """
SELECT document_id, coalesce(thumbs_up, 0) AS thumbs_up, coalesce(thumbs_down, 0) AS thumbs_down, coalesce(clicks, 0) AS clicks,
       total_impressions, coalesce(thumbs_up, 0) / total_impressions AS up_rate, coalesce(thumbs_down, 0) / total_impressions AS down_rate
FROM v_impressions LEFT JOIN v_counts USING (document_id)
WHERE document_id IN (SELECT document_id FROM v_docs WHERE deleted_at IS NULL)""",
    "v_vectors": """
SELECT vec_id AS point_key, vec_id // 5 AS document_id, vec_id % 5 AS chunk_index, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings""",
    "v_queries": """
SELECT vec_id AS query_id, vec_id % 150 AS user_id, CAST(vec_id AS VARCHAR) AS session_id, 'query ' || vec_id AS query_text,
       list_value(vec_id // 5, (vec_id * 31 + 1) % n) AS keyword_ids, CAST(embedding AS DOUBLE[]) AS vector
FROM embeddings, (SELECT count(*) AS n FROM documents)""",
    "v_scores": """
SELECT q.query_id, c.point_key, c.document_id, c.chunk_index,
       round(list_dot_product(q.vector, c.vector) / (sqrt(list_dot_product(q.vector, q.vector)) * sqrt(list_dot_product(c.vector, c.vector))), 9) AS score
FROM v_queries q, v_vectors c""",
    "v_hits": """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index, point_key) AS rank
FROM v_scores QUALIFY rank <= 15""",
    "v_best": """
SELECT query_id, point_key, document_id, chunk_index, score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank
FROM (SELECT * FROM v_hits QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_index, point_key) = 1)""",
    "v_top": "SELECT * FROM v_best WHERE rank <= 5",
    "v_chunks": """
SELECT document_id, i AS chunk_index, CASE WHEN n <= 500 THEN s ELSE substring(s, 1 + 450 * i, 500) END AS chunk_text
FROM (SELECT document_id, s, n, unnest(range(CASE WHEN n = 0 THEN 0 WHEN n <= 500 THEN 1 ELSE (n + 449) // 450 END)) AS i
      FROM (SELECT doc_id AS document_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS s,
                   length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS n FROM documents))""",
    "v_points": """
SELECT document_id, chunk_index, chunk_text,
       concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab', 1 + CAST('0x' || h[17:17] AS INTEGER) % 4, 1) || h[18:20], h[21:32]) AS id
FROM (SELECT *, sha1(unhex('7b93c9e3ff1f4c8fa3bfca3f1bf9a0e0') || encode(document_id || ':' || chunk_index)) AS h FROM v_chunks)""",
    "v_requests": """
SELECT event_type AS endpoint, user_id % 4 AS concurrency, ts AS started_at, value AS latency_ms,
       CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 500 ELSE 200 END AS status FROM events""",
    "v_tokens": "SELECT user_id AS region_id, event_id AS step, value / 500 AS p FROM events",
    "v_samples": f"""
SELECT ts, event_type AS metric, 'svc' || user_id % {SERVICES} AS service, event_type AS series,
       CAST(event_id % 1000 AS DOUBLE) AS value FROM events""",
    "v_increase": """
SELECT *, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS increase
FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, value) AS p FROM v_samples)""",
    "v_alias_log": f"""
SELECT 'model' || user_id % {MODELS} AS model, ts,
       row_number() OVER (PARTITION BY user_id % {MODELS} ORDER BY ts, event_id) AS version
FROM events WHERE event_type = 'purchase'""",
    "v_kpi": """
SELECT ts, CASE event_type WHEN 'view' THEN 'query' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'correction'
                WHEN 'purchase' THEN 'htr_request' ELSE 'rating' END AS kind, value / 491 AS similarity, value < 200 AS fallback FROM events""",
    "v_log": """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method,
       CASE event_type WHEN 'view' THEN '/api/documents/' || coalesce(upper(doc_uuid), '00000000-0000-0000-0000-00000000000f') || '/preview/'
            WHEN 'click' THEN '/api/ml/search/feedback/' WHEN 'signup' THEN '/api/ml/htr/corrections/' ELSE '/api/tags/' END AS path,
       CASE WHEN event_id % 7 = 0 THEN 403 ELSE 201 END AS status
FROM events LEFT JOIN v_ids ON doc_number = (event_id * 31) % ((SELECT count(*) FROM documents) + 50)""",
    "v_archive": """
SELECT CAST(correction_id AS VARCHAR) AS correction_id, CAST(region_id AS VARCHAR) AS region_id, CAST(document_id AS VARCHAR) AS document_id,
       coalesce(original_text, '') AS original_text, coalesce(corrected_text, '') AS corrected_text, opted_in,
       CAST(user_id AS VARCHAR) AS user_id,
       CASE WHEN microsecond(corrected_at) % 1000000 = 0 THEN strftime(corrected_at, '%Y-%m-%dT%H:%M:%S+00:00') ELSE strftime(corrected_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS corrected_at,
       crop_s3_url, 'v1' AS archive_version, strftime(corrected_at, '%Y-%m-%d') AS date
FROM v_corrections WHERE archived_at IS NULL""",
    "v_rate": """
SELECT ts, series, value, sum(increase) OVER (PARTITION BY series ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECOND PRECEDING AND CURRENT ROW) / 3600 AS rate
FROM v_increase""",
    "v_state": """
SELECT series, ts, value, CASE WHEN NOT on_ THEN 'inactive' WHEN ts - since >= INTERVAL 10 MINUTE THEN 'firing' ELSE 'pending' END AS state,
       CASE WHEN on_ THEN since END AS active_since
FROM (SELECT *, min(ts) OVER (PARTITION BY series, grp, on_) AS since
      FROM (SELECT *, count(*) FILTER (NOT on_) OVER (PARTITION BY series ORDER BY ts, value) AS grp
            FROM (SELECT *, rate > 14.0 / 3600 AS on_ FROM v_rate)))""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it uses, in order of definition."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in SQL and name not in needed:
                needed.add(name)
                visit(SQL[name])

    visit(sql)
    if not needed:
        return sql
    parts = ",\n".join(f"{name} AS ({text})" for name, text in SQL.items() if name in needed)
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{parts},\n{body[len(head):]}"
    return f"WITH {parts}\n{body}"
