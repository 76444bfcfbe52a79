import datetime as dt

from pyspark.sql import functions as F

from inkfold.operators import feedback as B
from inkfold.sources import writers as W

T0 = dt.datetime(2024, 3, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_vocabulary(spark):
    df = spark.createDataFrame(
        [(1, "search_click", None), (2, "search_rating", 1), (3, "search_rating", 0), (4, "search_rating", None), (5, "htr_correction", None)],
        "id INT, kind STRING, rating INT",
    )
    assert {r.id: r.feedback_type for r in B.normalize_feedback(df).collect()} == {1: "click", 2: "thumbs_up", 3: "thumbs_down"}


def test_stats(spark, tmp_path):
    sessions = spark.createDataFrame(
        [("s1", ["a", "b", "a"]), ("s2", ["a", None]), ("s3", ["gone"])], "session_id STRING, result_doc_ids ARRAY<STRING>"
    )
    feedback = spark.createDataFrame(
        [("a", "thumbs_up"), ("a", "click"), ("a", "click"), ("b", "thumbs_down"), ("never", "click"), ("gone", "click")],
        "document_id STRING, feedback_type STRING",
    )
    docs = spark.createDataFrame([("a", None), ("b", None), ("never", None), ("gone", T0)], "document_id STRING, deleted_at TIMESTAMP")
    stats = B.document_feedback_stats(sessions, feedback, docs)
    got = {r.document_id: (r.thumbs_up, r.thumbs_down, r.clicks, r.total_impressions, r.up_rate, r.down_rate) for r in stats.collect()}
    assert got == {"a": (1, 0, 2, 2, 0.5, 0.0), "b": (0, 1, 0, 1, 0.0, 1.0)}
    assert tuple(B.feedback_coverage(stats).first()) == (2, 1, 1)
    assert [r.document_id for r in B.top_documents_by_feedback(stats, 1).collect()] == ["a"]
    tested = sessions.withColumn("is_test_account", F.col("session_id") == "s1")
    assert {r.document_id for r in B.document_feedback_stats(tested, feedback, docs, exclude_test_accounts=True).collect()} == {"a"}
    for version in ("v1", "v2"):
        W.replace_stats(stats if version == "v2" else stats.limit(1), str(tmp_path / "stats"), version)
    assert W.read_stats(spark, str(tmp_path / "stats")).count() == 2


def test_recent(spark):
    rows = [(i, i % 2, at(i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "feedback_id BIGINT, document_id BIGINT, created_at TIMESTAMP")
    got = {(r.document_id, r.position): r.feedback_id for r in B.recent_feedback(df, 3).collect()}
    for doc in (0, 1):
        want = sorted((r for r in rows if r[1] == doc), key=lambda r: (r[2], r[0]), reverse=True)[:3]
        assert [got[(doc, i + 1)] for i in range(3)] == [r[0] for r in want]
    docs = spark.createDataFrame([(0, at(1)), (1, at(2)), (2, at(3))], "document_id BIGINT, created TIMESTAMP")
    counts = {r.document_id: r.feedback_count for r in B.feedback_per_document(docs, df, 2).collect()}
    assert counts == {2: 0, 1: 20}
    assert B.purge_expired(df, F.lit(at(90 * 86400 + 5))).count() == sum(r[2] >= at(5) for r in rows)


def test_attribution(spark):
    queries = spark.createDataFrame(
        [("q1", "s", at(0)), ("q2", "s", at(100)), ("q3", "anonymous", at(50))], "query_id STRING, session_id STRING, ts TIMESTAMP"
    )
    feedback = spark.createDataFrame(
        [
            (1, "s", None, at(50)), (2, "s", None, at(100)), (3, "s", "q1", at(150)), (4, "s", "lost", at(99)), (5, "s", None, at(5000)),
            (6, "anonymous", None, at(49)), (7, "anonymous", None, at(60)), (8, None, None, at(60)), (9, "x", "q3", at(0)),
        ],
        "feedback_id INT, session_id STRING, query_id STRING, ts TIMESTAMP",
    )
    got = {r.feedback_id: (r.matched_query_id, r.matched_by) for r in B.attribute_feedback(queries, feedback, 1800).collect()}
    assert got == {
        1: ("q1", "session"), 2: ("q2", "session"), 3: ("q1", "query_id"), 4: ("q1", "session"), 5: (None, None),
        6: (None, None), 7: ("q3", "session"), 8: (None, None), 9: ("q3", "query_id"),
    }


def test_retrieval_pairs(spark):
    shown = spark.createDataFrame([(1, "q", 10), (1, "q", 11), (1, "q", 12)], "query_id INT, query_text STRING, document_id INT")
    feedback = spark.createDataFrame([(1, 10, "click"), (1, 10, "thumbs_up"), (1, 11, "thumbs_down")], "query_id INT, document_id INT, feedback_type STRING")
    chunks = spark.createDataFrame([(1, 10, 0, 0.1), (1, 10, 1, 0.9), (1, 11, 0, 0.5)], "query_id INT, document_id INT, chunk_index INT, score DOUBLE")
    got = {(r.document_id, r.chunk_index, r.label) for r in B.retrieval_pairs(shown, feedback, chunks).collect()}
    assert got == {(10, 1, 1), (11, 0, 0)}


def test_kpis(spark):
    rows = [(at(1), "query", 0.8, True), (at(2), "query", 0.4, False), (at(3), "click", None, None), (at(4), "rating", None, None), (at(4000), "click", None, None)]
    df = spark.createDataFrame(rows, "ts TIMESTAMP, kind STRING, similarity DOUBLE, fallback BOOLEAN")
    first, second = B.usage_kpis(df).orderBy("window_start").collect()
    assert (first.ctr, first.fallback_rate, first.max_similarity, first.correction_rate) == (0.5, 0.5, 0.8, None)
    assert (second.clicks, second.ctr) == (1, None)
    assert B.usage_kpis(df, "2 hours", "10 minutes").count() == 18
