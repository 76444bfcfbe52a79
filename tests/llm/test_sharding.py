import zlib
from collections import Counter

from check import connect, rows
from inkfold.llm import sharding as S

SCHEMA = "doc_id bigint, text string, source string, shard int, slot string, row int"


def sample():
    data = [(i, f"text {i % 90} é", ["a", "a", "a", "b", None, "ü"][i % 6], 1, "x", i) for i in range(600)]
    data += [(7, "same", "a", 1, "x", 0)] * 40 + [(None, "no id", None, 1, "x", 0)] * 5 + [(800, None, "b", 1, "x", 0), (801, "", "b", 1, "x", 0)]
    return [*data, (900, "long " * 100_000, "c", 1, "x", 0)]


def test_counts_and_mixture(spark):
    data = sample()
    got = S.assign_shards(spark.createDataFrame(data, SCHEMA), 8, bucket_rows=16).toPandas()
    assert len(got) == len(data)
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and sorted(sizes.index) == list(range(8))
    for shard, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(sizes[shard]))
    for _, own in got.groupby("skey"):
        counts = own.groupby("shard").size().reindex(range(8), fill_value=0)
        assert counts.max() - counts.min() <= 3
        assert sorted(own["rank"]) == list(range(len(own)))
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in data)
    mine = Counter((None if d != d else int(d), s, c) for d, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    assert mine == want


def test_depends_on_rows_and_seed_only(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    columns = ["skey", "dkey", "size", "text_crc32", "copy", "rank", "shard", "slot"]
    one = S.assign_shards(df, 5, bucket_rows=7).select(columns).toPandas()
    two = S.assign_shards(df.repartition(9), 5, bucket_rows=1000).select(columns).toPandas()
    other = S.assign_shards(df, 5, seed=3).select(columns).toPandas()
    assert rows(one) == rows(two) != rows(other)


def test_rows_and_files(spark, tmp_path):
    data = sample()
    df = spark.createDataFrame(data, SCHEMA)
    placed = S.shard_rows(df, 4)
    assert placed.count() == len(data)
    assert sorted(map(str, placed.select("row.*").collect())) == sorted(map(str, df.collect()))
    assert placed.select("shard", "slot").distinct().count() == len(data)
    S.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back.select("shard", "slot", "row.doc_id").toPandas()) == rows(placed.select("shard", "slot", "row.doc_id").toPandas())


def test_few_rows(spark):
    assert S.assign_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    assert S.shard_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    got = S.assign_shards(spark.createDataFrame([(1, "x", "a", 0, "", 0), (2, "y", "a", 0, "", 0)], SCHEMA), 8).collect()
    assert [r.slot for r in got] == [0, 0] and len({r.shard for r in got}) == 2


def test_query_equals_sql(spark, sf):
    assert rows(S.op11_sharding(spark, sf).toPandas()) == rows(connect(sf).execute(S.OP11_SQL).df())
