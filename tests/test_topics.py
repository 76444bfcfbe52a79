import datetime as dt
import json

from pyspark.sql import functions as F

from inkfold.sources import readers as R
from inkfold.sources import topics as P

START = dt.datetime(2024, 3, 1)
DAY = 86_400_000_000
ZERO = int(START.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000


def records(spark, days, per_day=40):
    data = []
    for day in days:
        for i in range(per_day):
            ts = START + dt.timedelta(days=day, seconds=i)
            body = {"event_id": f"{day}-{i}", "event_type": "feedback.v1", "emitted_at": ts.isoformat() + "Z", "kind": "click", "doc_number": i}
            data.append((f"k{i % 13}", ts, json.dumps(body) if i % 10 else "{broken"))
    return spark.createDataFrame(data, "key STRING, ts TIMESTAMP, value STRING")


def test_offsets_are_consecutive_and_keys_stay_together(spark, tmp_path):
    path = str(tmp_path / "topic")
    P.append_topic(records(spark, [0, 1]), path, partitions=3, segment_rows=16)
    P.append_topic(records(spark, [2]), path, partitions=3, segment_rows=16)
    got = P.read_topic(spark, path).toPandas()
    assert len(got) == 120 and got.groupby("key").partition.nunique().max() == 1
    for p, own in got.groupby("partition"):
        assert sorted(own.offset) == list(range(len(own))) and P.ends(path)[p] == len(own)
        assert own.sort_values("offset").ts.is_monotonic_increasing
    assert all(s.last - s.first <= 16 for s in P.segments(path))


def test_a_replay_opens_only_its_segments(spark, tmp_path):
    path = str(tmp_path / "topic")
    for day in range(5):
        P.append_topic(records(spark, [day]), path, partitions=2, segment_rows=10)
    since, until = ZERO + 2 * DAY, ZERO + 3 * DAY
    few = P.segments(path, since, until)
    assert 0 < len(few) == len(P.segments(path)) / 5
    assert len(P.TopicReader({"path": path, "since": str(since), "until": str(until)}).partitions()) == len(few)
    rows = P.read_topic(spark, path, since + 10_000_000, until)
    assert rows.count() == 30 and rows.where(F.to_date("ts") != F.lit("2024-03-03").cast("date")).count() == 0
    assert P.read_topic(spark, path, 0, 1).count() == 0 and P.read_topic(spark, str(tmp_path / "none")).count() == 0


def test_stream_takes_up_its_offsets(spark, tmp_path):
    path = str(tmp_path / "topic")

    def run(checkpoint, group=None):
        stream = P.read_topic(spark, path, streaming=True, group=group)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{checkpoint}/c").trigger(availableNow=True)
        writer.start(f"{tmp_path}/{checkpoint}/rows").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{checkpoint}/rows").count()

    P.append_topic(records(spark, [0]), path, partitions=2)
    assert run("a", "g") == 40
    P.append_topic(records(spark, [1]), path, partitions=2)
    assert run("a", "g") == 80
    P.append_topic(records(spark, [2]), path, partitions=2)
    # A consumer of the group without a checkpoint goes on behind what was committed, one without a group starts at the earliest.
    assert run("b", "g") in (40, 80) and run("c") == 120


def test_read_events_from_a_topic(spark, tmp_path):
    path = str(tmp_path / "topic")
    P.append_topic(records(spark, [0]), path)
    batch = R.read_events(spark, "feedback", log=path)
    assert batch.where("event_id IS NULL AND raw = '{broken'").count() == 4 and batch.where("kind = 'click'").count() == 36
    stream = R.read_events(spark, "feedback", log=path, streaming=True)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
    writer.start(f"{tmp_path}/rows").awaitTermination()
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/rows").collect())) == sorted(map(str, batch.collect()))


def test_many_small_segments_share_tasks(spark, tmp_path):
    """Hundreds of segments of a few records are read by a few tasks, each record once and in order."""
    path = str(tmp_path / "topic")
    P.append_topic(records(spark, range(30)), path, partitions=2, segment_rows=3)
    assert len(P.segments(path)) > 300
    got = P.read_topic(spark, path)
    assert got.rdd.getNumPartitions() <= 4
    rows = got.collect()
    assert len({(r.partition, r.offset) for r in rows}) == len(rows) == 1200
