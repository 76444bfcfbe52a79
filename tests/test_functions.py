import hashlib
import math
import uuid
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from inkfold.functions import text as X
from inkfold.functions import vectors as V


def chunks_by_rule(text, size=500, overlap=50):
    text = text.strip()
    if not text:
        return []
    if len(text) <= size:
        return [text]
    return [text[i : i + size] for i in range(0, len(text), max(size - overlap, 1))]


def test_strip_agrees_with_python_for_every_bmp_character(spark):
    chars = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, chr(c) + "a" + chr(c)) for c in chars], "c INT, s STRING")
    got = {r.c: r.t for r in df.select("c", X.py_strip("s").alias("t")).collect()}
    assert all(got[c] == (chr(c) + "a" + chr(c)).strip() for c in chars)


@pytest.mark.parametrize("length,count", [(0, 0), (500, 1), (501, 2), (900, 2), (901, 3)])
def test_chunk_counts_at_the_borders(spark, length, count):
    df = spark.createDataFrame([("é" * length,)], "s STRING")
    assert df.select(F.size(X.chunk_array("s"))).first()[0] == count


def test_chunks_of_whole_documents(spark, sf):
    rows = (
        spark.read.parquet(f"{sf}/documents.parquet").select("text", X.chunk_array("text").alias("c")).collect()
    )
    assert all(r.c == chunks_by_rule(r.text) for r in rows)
    # Without overlap counted twice, the chunks give the stripped text back.
    assert all("".join(c[:450] for c in r.c[:-1]) + (r.c[-1] if r.c else "") == r.text.strip() for r in rows)


def test_chunks_with_other_sizes_and_line_breaks(spark):
    text = " 　" + "".join(chr(97 + i % 26) + ("\n" if i % 7 == 0 else "") + ("😀" if i % 5 == 0 else "") for i in range(300))
    df = spark.createDataFrame([(text,), (None,), ("   ",)], "s STRING")
    for size, overlap in [(10, 0), (10, 9), (10, 15), (7, 3), (1000, 10)]:
        got = [r[0] for r in df.select(X.chunk_array("s", size, overlap)).collect()]
        assert got == [chunks_by_rule(text, size, overlap), [], []]


def test_point_ids(spark):
    df = spark.createDataFrame([("1", 0), ("ünï", 12), ("a:b", 3)], "d STRING, i INT")
    got = [r[0] for r in df.select(X.point_id("d", "i")).collect()]
    assert got[0] == "ede49041-aecf-50f2-bbdc-004cb7cf5e66"
    assert got == [str(uuid.uuid5(X.POINT_NAMESPACE, n)) for n in ("1:0", "ünï:12", "a:b:3")]


def test_split_bucket(spark):
    df = spark.range(2000)
    got = {r.id: r.b for r in df.select("id", X.split_bucket("id").alias("b")).collect()}
    want = {i: int(hashlib.sha256(str(i).encode()).hexdigest(), 16) % 10000 for i in range(2000)}
    assert got == want


def test_parse_s3_uri(spark):
    urls = [
        "s3://bucket/a/b.png", "s3://bucket/a/", "s3://bucket", "s3://bucket//x", "S3://Bucket/k", "http://bucket/a",
        "s3:///a", "s3://", "", "s3:/x/y", "s3://b/k?v=1", "s3://b/k#f", "bucket/a",
    ]

    def want(url):
        parsed = urlparse(url)
        if parsed.scheme != "s3" or not parsed.netloc:
            return None
        return parsed.netloc, parsed.path.lstrip("/")

    df = spark.createDataFrame([(u,) for u in urls], "u STRING")
    got = [r[0] and tuple(r[0]) for r in df.select(X.parse_s3_uri("u")).collect()]
    assert got == [want(u) for u in urls]


def test_timestamp_texts(spark):
    df = spark.sql("SELECT timestamp'2024-03-01 05:06:07' AS a, timestamp'2024-03-01 05:06:07.120034' AS b")
    row = df.select(X.iso_offset("a"), X.iso_offset("b"), X.iso_millis("b"), X.date_of("a")).first()
    assert list(row) == [
        "2024-03-01T05:06:07+00:00", "2024-03-01T05:06:07.120034+00:00", "2024-03-01T05:06:07.120Z", "2024-03-01",
    ]


def test_users_sessions_metadata(spark):
    df = spark.createDataFrame([("", '{"session_id": "s1"}'), ("ann", "{}"), (None, None)], "u STRING, m STRING")
    got = df.select(
        X.normalize_user("u"), X.normalize_session("u"), X.metadata_field("m", "session_id", "anonymous")
    ).collect()
    assert [tuple(r) for r in got] == [(None, "anonymous", "s1"), ("ann", "ann", "anonymous"), (None, "anonymous", "anonymous")]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    got = [r[0] for r in df.select(V.cosine("a", "b")).collect()]
    assert math.isclose(got[0], 1 / math.sqrt(2)) and got[1] is None
