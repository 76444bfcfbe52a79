import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from inkfold.operators import corrections as C
from inkfold.sources import readers as R
from inkfold.sources import writers as W

ARCHIVED = (
    "correction_id BIGINT, region_id BIGINT, document_id BIGINT, original_text STRING, corrected_text STRING, "
    "opted_in BOOLEAN, user_id STRING, corrected_at TIMESTAMP, crop_s3_url STRING"
)


def at(second):
    return dt.datetime(2024, 3, 1, 0, 0, second)


def row(cid, region=1, doc=1, old="a", new="b", opted=True, user="u", when=0, crop="s3://b/k"):
    return (cid, region, doc, old, new, opted, user, at(when) if when is not None else None, crop)


def test_latest_per_region(spark):
    df = spark.createDataFrame(
        [row(1, when=1), row(3, when=5), row(2, when=5), row(4, region=2, when=None), row(5, region=2, when=0)], ARCHIVED
    )
    assert {r.region_id: r.correction_id for r in C.latest_per_region(df).collect()} == {1: 2, 2: 5}


def test_eligibility(spark):
    docs = spark.createDataFrame(
        [(1, "user_upload", None), (2, "test", None), (3, "user_upload", at(0))],
        "document_id BIGINT, source STRING, deleted_at TIMESTAMP",
    )
    df = spark.createDataFrame(
        [row(1), row(2, opted=None), row(3, opted=False), row(4, new=" 　\n"), row(5, new=None), row(6, doc=2), row(7, doc=3), row(8, doc=4)],
        ARCHIVED,
    )
    assert [r.correction_id for r in C.eligible_corrections(df, docs).collect()] == [1]
    marked = df.withColumn("excluded_from_training", F.lit(True))
    assert C.eligible_corrections(marked, docs).count() == 0


def test_quality_reasons_in_order(spark):
    df = spark.createDataFrame(
        [
            row(1, old="x", new="x", crop="http://bad"),
            row(2, old="x", new="  ", crop="http://bad"),
            row(3, new="long" * 99, crop="http://bad"),
            row(4, crop="s3://b/missing", new="long" * 99),
            row(5, old="Signed,", new="x" * 80),
            row(6, old="Signed,", new="x" * 70),
            row(7, old="", new="x" * 11),
        ],
        ARCHIVED,
    )
    crops = spark.createDataFrame([("s3://b/k",), ("s3://b/k",)], "crop_s3_url STRING")
    judged = C.quality_reasons(df, crops)
    got = {r.correction_id: r.reason for r in judged.collect()}
    assert [got[i] and got[i][:2] for i in range(1, 8)] == ["R1", "R2", "R3", "R4", "R5", None, "R5"]
    assert C.accepted(judged).count() == 1
    report = C.quality_report(judged, samples=1).first()
    assert (report.total_candidates, report.accepted, report.rejected) == (7, 1, 6)
    assert report.rejection_counts["R5_correction_too_long"] == 2
    assert [s.correction_id for s in report.rejection_samples["R5_correction_too_long"]] == ["5"]


def test_split_is_stable_and_disjoint(spark):
    df = spark.range(1000).select(F.col("id").alias("document_id")).union(spark.range(500, 600).select("id"))
    split = C.document_grouped_split(df.orderBy(F.rand(1)))
    want = {i: "val" if int(hashlib.sha256(str(i).encode()).hexdigest(), 16) % 10000 / 10000 < 0.2 else "train" for i in range(1000)}
    assert {r.document_id: r.split for r in split.collect()} == want
    assert sum(v == "val" for v in want.values()) == 212
    assert C.split_overlap(split).count() == 0
    assert {r.overlap for r in C.split_counts(split).collect()} == {0}


def test_snapshot_projection(spark):
    df = spark.createDataFrame([row(1, old=None, user=""), row(2, user="eve", when=7)], ARCHIVED)
    got = C.snapshot_projection(C.document_grouped_split(df)).orderBy("writer_id").collect()
    assert [(r.original_text, r.writer_id, r.correction_date, r.source) for r in got] == [
        ("a", "eve", "2024-03-01", "user_correction"), ("", "unknown", "2024-03-01", "user_correction"),
    ]
    text = C.snapshot_projection(C.document_grouped_split(df).withColumn("corrected_at", F.lit("2024-03-09T01:02:03+00:00")))
    assert {r.correction_date for r in text.collect()} == {"2024-03-09"}


@pytest.mark.parametrize("rows,shards", [(1001, [500, 500, 1]), (500, [500]), (0, [])])
def test_exact_shards(spark, tmp_path, rows, shards):
    df = spark.range(rows).select(
        F.lit("train").alias("split"), ((F.col("id") * 7919) % 1009).alias("place"), F.col("id").alias("region_id")
    )
    counts = W.write_snapshot(df, str(tmp_path / "s"), "v1", ["place"], 500)
    assert [r["rows"] for r in counts.orderBy("shard_id").collect()] == shards
    files = sorted((tmp_path / "s" / "v1").rglob("*.parquet"))
    if rows:
        import pyarrow.parquet as pq

        tables = [pq.ParquetFile(f).read() for f in files]
        assert sorted(t.num_rows for t in tables) == sorted(shards)
        by_start = sorted((t["place"].to_pylist() for t in tables), key=lambda p: p[0])
        assert sum(by_start, []) == sorted(sum(by_start, []))
    else:
        assert files == []


def test_shard_positions_with_one_hot_value(spark):
    """All order values equal but for the tie column: positions still run through."""
    df = spark.range(3000).select(F.lit("train").alias("split"), F.lit(1).alias("day"), "id")
    got = C.rows_to_shards(df, ["day", "id"], 1000, partitions=7).collect()
    assert all(r.row_index == r.id and r.shard_id == r.id // 1000 for r in got)


def test_archive_round_trip(spark, tmp_path):
    path = str(tmp_path / "archive")
    assert R.read_correction_archive(spark, path).count() == 0
    df = spark.createDataFrame([row(1, old=None), row(2, when=None, user=""), row(3)], ARCHIVED)
    W.write_correction_archive(df.where("correction_id < 3"), path, F.lit("2024-05-01").cast("timestamp"))
    W.write_correction_archive(df, path, F.lit("2024-06-01").cast("timestamp"))
    (tmp_path / "archive" / "date=2024-03-01" / "broken.json").write_text("{not json\n")
    rows = R.read_correction_archive(spark, path).collect()
    got = {r.correction_id: r for r in rows}
    assert sorted(r.correction_id for r in rows) == ["1", "2", "3"]
    assert got["1"].original_text == "" and got["1"].date == "2024-03-01" and got["1"].archive_version == "v1"
    assert got["2"].date == "2024-05-01" and got["2"].user_id is None
    old = R.read_correction_archive(spark, path, as_of="2024-05-15T00:00:00+00:00")
    assert sorted(r.correction_id for r in old.collect()) == ["1", "2"]


def test_indented_archive_objects(spark, tmp_path):
    folder = tmp_path / "archive" / "date=2024-03-01"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{\n  "correction_id": "a",\n  "opted_in": true\n}')
    (folder / "b.json").write_text("oops")
    got = R.read_correction_archive(spark, str(tmp_path / "archive"), one_object_per_file=True).collect()
    assert [(r.correction_id, r.opted_in, r.date) for r in got] == [("a", True, "2024-03-01")]


def test_archive_report(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-01",), (None,)], "date STRING")
    assert {r["date"]: r.corrections for r in C.archive_report(df).collect()} == {"2024-01-01": 2, "unknown": 1, "total": 3}


def test_manifest(spark, tmp_path):
    counts = spark.createDataFrame([("train", 0, 500), ("train", 1, 3), ("val", 0, 9)], "split STRING, shard_id INT, rows BIGINT")
    m = W.manifest(counts, W.snapshot_version(dt.datetime(2024, 2, 1, tzinfo=dt.UTC)), "now")
    W.write_manifest(m, str(tmp_path), "v_20240201_000000")
    got = spark.read.json(str(tmp_path / "v_20240201_000000" / "_manifest")).first()
    assert got.version == "v_20240201_000000" and got.candidate_selection.dedup_by_region == "keep_latest"
    assert (got.counts.train, got.counts.val, got.counts.total, got.shards.train, got.shards.val) == (503, 9, 512, 2, 1)


def test_missing_split_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.read_training_shards(spark, str(tmp_path), "train")
    spark.sql("SELECT 'i' AS image_id, X'00' AS image_png, 't' AS transcription, 'train' AS split").write.parquet(
        str(tmp_path / "train")
    )
    assert R.read_line_images(spark, str(tmp_path), "train").first().transcription == "t"


def test_training_text(spark):
    lines = spark.createDataFrame(
        [("a", b"1", " one two three "), ("b", None, "x"), ("c", b"1", " \t"), ("d", b"1", None)],
        "image_id STRING, image_png BINARY, transcription STRING",
    )
    good = C.training_text_rows(lines)
    labels = C.truncate_labels(good, lambda texts: [[len(w) for w in t.split()] for t in texts], 2).collect()
    assert [(r.image_id, r.transcription, r.label_ids) for r in labels] == [("a", "one two three", [3, 3])]
    assert C.training_set(good, None).count() == 1


def test_unarchived_and_denormalised(spark):
    regions = spark.createDataFrame([("r1", "p1", "s3://b/k", "out")], "id STRING, page_id STRING, crop_s3_url STRING, htr_output STRING")
    pages = spark.createDataFrame([("p1", "d1")], "id STRING, document_id STRING")
    docs = spark.createDataFrame([("d1",)], "id STRING")
    rows = [("c1", "r1", "t", True, "u", at(0), None), ("c2", "r1", "t", True, "u", at(0), at(1)), ("c3", "r9", "t", True, "u", at(0), None)]
    corrections = spark.createDataFrame(
        rows, "id STRING, region_id STRING, corrected_text STRING, opted_in BOOLEAN, user_id STRING, corrected_at TIMESTAMP, archived_at TIMESTAMP"
    )
    got = C.unarchived(C.denormalize_corrections(corrections, regions, pages, docs)).collect()
    assert [(r.correction_id, r.document_id, r.original_text) for r in got] == [("c1", "d1", "out")]
