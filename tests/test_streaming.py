import datetime as dt
import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from inkfold.operators import documents as D
from inkfold.operators import monitoring as M
from inkfold.operators.search import hashing_encoder
from inkfold.schemas import CHUNK_POINTS, DOCUMENTS
from inkfold.sources import readers as R
from inkfold.sources import writers as W
from inkfold.streaming import jobs as J
from inkfold.streaming.keyed import rocksdb


def iso(second):
    return (dt.datetime(2024, 3, 1) + dt.timedelta(seconds=second)).isoformat(timespec="milliseconds") + "Z"


def put(folder, name, records):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def drain(stream, folder):
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True)
    writer.start(f"{folder}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def upload(n, second, title="t", pages=1, event=None):
    return {"event_id": event or f"e{n}-{second}", "event_type": "uploads.v1", "emitted_at": iso(second), "doc_number": n, "title": title, "page_count": pages, "source": "user_upload"}


def recognise(batch):
    none = F.lit(None).cast("string")
    return batch.select(
        F.concat(F.lit("d"), F.col("doc_number").cast("string")).alias("id"), "doc_number", F.col("title").alias("filename"), "source",
        "page_count", none.alias("tesseract_text"), none.alias("htr_text"), F.col("title").alias("merged_text"),
        F.lit(None).cast("timestamp").alias("deleted_at"), F.col("ts").alias("updated_at"),
    )


def test_uploads_with_bad_records_and_redelivery(spark, tmp_path):
    topic = tmp_path / "uploads"
    put(topic, "1.json", [upload(1, 0, "one"), "{broken", upload(2, 0, "two"), {"event_id": "x", "title": "no number"}])

    def run():
        stream = R.read_events(spark, "uploads", path=str(topic), streaming=True)
        J.process_uploads(stream, recognise, f"{tmp_path}/t", f"{tmp_path}/bad", f"{tmp_path}/c", once=True).awaitTermination()
        return {r.doc_number: (r.filename, r.merged_text, r.page_count) for r in D.newest_documents(W.read_versions(spark, f"{tmp_path}/t", DOCUMENTS)).collect()}

    assert run() == {1: ("one", "one", 1), 2: ("two", "two", 1)}
    assert spark.read.json(f"{tmp_path}/bad").count() == 2
    put(topic, "2.json", [upload(1, 50, "new", 4), upload(1, 20, "older", 3), upload(2, 0, "two"), upload(3, 9, "three")])
    assert run() == {1: ("one", "new", 4), 2: ("two", "two", 1), 3: ("three", "three", 1)}


def test_uploads_leave_corrected_documents(spark, tmp_path):
    topic = tmp_path / "uploads"
    put(topic, "1.json", [upload(1, 0), upload(2, 0)])

    def history():
        pages = spark.createDataFrame([("p1", "d1")], "id STRING, document_id STRING")
        regions = spark.createDataFrame([("r1", "p1")], "id STRING, page_id STRING")
        return pages, regions, spark.createDataFrame([("r1",)], "region_id STRING")

    stream = R.read_events(spark, "uploads", path=str(topic), streaming=True)
    J.process_uploads(stream, recognise, f"{tmp_path}/t", f"{tmp_path}/bad", f"{tmp_path}/c", history, once=True).awaitTermination()
    assert [r.doc_number for r in D.newest_documents(W.read_versions(spark, f"{tmp_path}/t", DOCUMENTS)).collect()] == [2]


def test_wire_names(spark, tmp_path):
    put(tmp_path / "f", "1.json", [{"event_id": "a", "their_id": 7, "emitted_at": iso(0), "kind": "search_click"}])
    row = R.read_events(spark, "feedback", path=str(tmp_path / "f"), rename={"doc_number": "their_id"}).first()
    assert (row.doc_number, row.kind, row.ts) == (7, "search_click", dt.datetime(2024, 3, 1))


def test_index_follows_updates(spark, tmp_path):
    folder = tmp_path / "docs"
    schema = "document_id STRING, text STRING, ts TIMESTAMP"

    def run(name, rows):
        put(folder, name, [{"document_id": d, "text": t, "ts": iso(s)} for d, t, s in rows])
        stream = spark.readStream.schema(schema).json(str(folder))
        J.index_documents(stream, hashing_encoder, f"{tmp_path}/t", f"{tmp_path}/c", once=True).awaitTermination()
        table = D.newest_of(W.read_versions(spark, f"{tmp_path}/t", CHUNK_POINTS), "document_id")
        return {(r.document_id, r.chunk_index): len(r.chunk_text) for r in table.collect()}

    assert run("1.json", [("a", "x" * 1000, 1), ("b", "y", 1), ("c", "  ", 1)]) == {("a", 0): 500, ("a", 1): 500, ("a", 2): 100, ("b", 0): 1}
    # Shorter text leaves no stale tail; blank content changes nothing.
    assert run("2.json", [("a", "z" * 7, 9), ("a", "w" * 900, 5), ("b", "", 9)]) == {("a", 0): 7, ("b", 0): 1}


def test_archive_stream_is_incremental(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "correction_id STRING, region_id STRING, document_id STRING, original_text STRING, corrected_text STRING, opted_in BOOLEAN, user_id STRING, corrected_at TIMESTAMP, crop_s3_url STRING"

    def run(name, ids):
        put(folder, name, [{"correction_id": i, "region_id": "r", "corrected_at": iso(1)} for i in ids])
        J.archive_stream(spark.readStream.schema(schema).json(str(folder)), f"{tmp_path}/a", f"{tmp_path}/c").awaitTermination()
        return sorted(r.correction_id for r in R.read_correction_archive(spark, f"{tmp_path}/a").collect())

    assert run("1.json", ["a", "a", "b"]) == ["a", "b"]
    assert run("2.json", ["b", "c"]) == ["a", "b", "c"]


def test_dedup_and_replay(spark, tmp_path):
    events = [{"event_id": f"e{i}", "emitted_at": iso(i), "kind": "search_click"} for i in range(5)]
    put(tmp_path / "f", "1.json", events)
    put(tmp_path / "f", "2.json", events[:3])
    stream = R.read_events(spark, "feedback", path=str(tmp_path / "f"), streaming=True)
    assert drain(J.dedup_events(stream), tmp_path / "out").count() == 5
    batch = R.read_events(spark, "feedback", path=str(tmp_path / "f"))
    assert J.dedup_events(batch).count() == 5
    bounds = [F.lit(f"2024-03-01 00:00:0{s}").cast("timestamp") for s in (1, 3)]
    assert sorted(r.event_id for r in R.replay_events(batch, *bounds).collect()) == ["e1", "e2"]


def test_late_kpi_rows_are_dropped(spark, tmp_path):
    folder, schema = tmp_path / "in", "ts TIMESTAMP, kind STRING, similarity DOUBLE, fallback BOOLEAN"

    def run(name, seconds):
        put(folder, name, [{"ts": iso(s), "kind": "query", "similarity": 0.5, "fallback": False} for s in seconds])
        return drain(J.kpi_stream(spark.readStream.schema(schema).json(str(folder))), tmp_path / "out")

    run("1.json", [10, 20, 9000])
    got = run("2.json", [30, 20000])
    assert {r.window_start.hour: r.queries for r in got.collect()} == {0: 2, 2: 1}


def test_alert_stream_over_several_batches(spark, tmp_path):
    folder = tmp_path / "in"
    points = [(t, 60 < t < 900 and t != 300) for t in range(0, 1200, 30)]

    def run(name, part):
        put(folder, name, [{"series": s, "ts": iso(t), "breached": on} for t, on in part for s in ("a", "b")])
        stream = spark.readStream.schema("series STRING, ts TIMESTAMP, breached BOOLEAN").json(str(folder))
        with rocksdb(spark):
            return drain(J.alert_stream(stream, 300), tmp_path / "out")

    run("1.json", points[:7])
    run("2.json", points[7:19])
    got = run("3.json", points[19:]).where("series = 'a'").orderBy("ts").collect()
    start = dt.datetime(2024, 3, 1)
    rows = spark.createDataFrame([("a", start + dt.timedelta(seconds=t), on) for t, on in points], "series STRING, ts TIMESTAMP, on BOOLEAN")
    states = M.alert_state(rows, F.col("on"), 300).orderBy("ts").collect()
    want, shown = [], "inactive"
    for r in states:
        if r.state != shown:
            want.append((r.ts, shown, r.state))
            shown = r.state
    assert [(r.ts, r.from_state, r.to_state) for r in got] == want and len(want) == 5


def test_stream_join_keeps_unmatched_feedback(spark, tmp_path):
    put(tmp_path / "q", "1.json", [{"event_id": "q1", "emitted_at": iso(0), "query_text": "x"}, {"event_id": "q9", "emitted_at": iso(90000)}])
    clicks = [{"event_id": "f1", "emitted_at": iso(60), "query_id": "q1"}, {"event_id": "f2", "emitted_at": iso(61), "query_id": "none"}, {"event_id": "f3", "emitted_at": iso(7200), "query_id": "q1"}, {"event_id": "f9", "emitted_at": iso(90000), "query_id": "z"}]
    put(tmp_path / "f", "1.json", clicks)
    queries = R.read_events(spark, "queries", path=str(tmp_path / "q"), streaming=True)
    feedback = R.read_events(spark, "feedback", path=str(tmp_path / "f"), streaming=True)
    got = drain(J.attribute_feedback_stream(queries, feedback), tmp_path / "out")
    assert {r.event_id: r.matched_query_id for r in got.collect()} == {"f1": "q1", "f2": None, "f3": None}


def test_versions_resolve_across_batches_and_compaction(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k STRING, v STRING"

    def put_batch(n, rows):
        df = spark.createDataFrame(rows, "k STRING, v STRING, s INT")
        W.append_version(df.select("k", "v", F.timestamp_seconds("s").alias("_version")), path, n, F.col("_version"))

    def now():
        return sorted((r.k, r.v) for r in D.newest_of(W.read_versions(spark, path, schema), "k").collect())

    assert now() == []
    put_batch(0, [("a", "1", 10), ("a", "2", 10), ("b", "1", 10)])
    put_batch(1, [("a", "old", 5), ("b", "3", 20)])
    put_batch(1, [("a", "old", 5), ("b", "3", 20)])
    assert now() == [("a", "1"), ("a", "2"), ("b", "3")]
    W.compact_versions(spark, path, schema, lambda rows: D.newest_of(rows, "k"), "v1")
    assert now() == [("a", "1"), ("a", "2"), ("b", "3")]
    put_batch(2, [("a", "9", 30), ("b", "late", 15)])
    assert now() == [("a", "9"), ("b", "3")]

def test_ml_tables(spark, tmp_path):
    spark.sql("SELECT 'd' AS id, 5 AS their_id, 'f' AS filename, 'test' AS source, 1 AS page_count, '' AS tesseract_text, '' AS htr_text, '' AS merged_text, CAST(NULL AS TIMESTAMP) AS deleted_at").withColumn(
        "their_id", F.col("their_id").cast("bigint")
    ).write.parquet(str(tmp_path / "documents"))
    tables = R.read_ml_tables(spark, str(tmp_path), tables=["documents"], rename={"doc_number": "their_id"})
    assert tables["documents"].first().doc_number == 5


def test_alerts_of_an_unordered_feed(spark, tmp_path):
    """Samples a little late, in a later batch, count; those behind the watermark are counted as late; a silent series is ended by its timer."""
    folder, schema = tmp_path / "in", "series STRING, ts TIMESTAMP, breached BOOLEAN"

    def run(name, points):
        put(folder, name, [{"series": s, "ts": iso(t), "breached": on} for s, t, on in points])
        stream = spark.readStream.schema(schema).json(str(folder))
        J.write_alerts(stream, 300, f"{tmp_path}/changes", f"{tmp_path}/late", f"{tmp_path}/c", once=True).awaitTermination()

    run("1.json", [("a", 100, True), ("a", 200, True), ("b", 150, True)])
    # The end at 199 comes after the sample of 200, so the hold starts anew and nothing fires at 420.
    run("2.json", [("a", 420, True), ("a", 199, False)])
    run("3.json", [("a", 600, False), ("c", 5000, False)])
    run("4.json", [("a", 300, True), ("a", 300, True), ("b", 310, False), ("c", 5001, False)])
    start = dt.datetime(2024, 3, 1)
    got = spark.read.parquet(f"{tmp_path}/changes").orderBy("series", "ts").collect()
    assert [(r.series, (r.ts - start).seconds, r.from_state, r.to_state) for r in got] == [
        ("a", 100, "inactive", "pending"), ("a", 199, "pending", "inactive"), ("a", 200, "inactive", "pending"),
        ("a", 600, "pending", "inactive"), ("b", 150, "inactive", "pending"),
    ]
    late = spark.read.parquet(f"{tmp_path}/late").collect()
    assert {(r.series, (r.ts - start).seconds, r.n) for r in late} == {("a", 300, 2), ("b", 310, 1)}


class ListOfOneKey:
    """Stands for the state of one key; counts the elements that are sent to it."""

    def __init__(self):
        self.rows, self.sent, self.timers = [], 0, []

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return ListOfOneKey()

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.mark

    def appendValue(self, row):
        self.appendList([row])

    def appendList(self, rows):
        self.sent += len(rows)
        self.rows += rows

    def put(self, rows):
        self.rows = []
        self.appendList(rows)

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []

    def exists(self):
        return False

    def update(self, row):
        pass


def test_alert_samples_are_stored_in_slices():
    """A series' samples are few elements of its list state, not one each; what has not been passed waits on."""
    state = ListOfOneKey()
    states = J.AlertStates(300_000_000)
    states.init(state)
    us = np.arange(100_000, dtype=np.int64) * 1_000_000 + 1_000_000
    frames = [pd.DataFrame({"us": us[i : i + 10_000], "breached": us[i : i + 10_000] <= 500_000_000}) for i in range(0, 100_000, 10_000)][::-1]
    state.mark = 0
    assert not list(states.handleInputRows(("a",), iter(frames), state))
    state.mark = 60_000_000
    got = pd.concat(states.handleExpiredTimer(("a",), state, None))
    assert [tuple(r) for r in got[["us", "from_state", "to_state"]].itertuples(index=False)] == [
        (1_000_000, "inactive", "pending"), (301_000_000, "pending", "firing"), (501_000_000, "firing", "inactive"),
    ]
    assert state.sent <= 20 and sum(len(p) for (p,) in state.rows) == 40_000 * 8 and state.timers[-1] == 60_001_001
