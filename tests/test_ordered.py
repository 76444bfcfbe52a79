"""The chunked functions must equal the plain window over the whole key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkfold.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        # One key holds most rows; times repeat and leave gaps of several chunks.
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}"
        second = rng.randrange(40) * 997 + rng.randrange(3)
        data.append((key, i, second, float(rng.randrange(10)), rng.random() < 0.4))
    df = spark.createDataFrame(data, "k STRING, id INT, s INT, v DOUBLE, on BOOLEAN")
    return df.withColumn("ts", F.timestamp_seconds("s")).cache()


def order():
    return Window.partitionBy("k").orderBy("ts", "id")


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_running_sum_and_count(rows):
    upto = order().rowsBetween(Window.unboundedPreceding, 0)
    got = O.running_sum(rows, ["k"], "ts", F.col("v"), "x", ["id"])
    same(got.select("id", "x"), rows.select("id", F.sum("v").over(upto).alias("x")))
    got = O.running_count(rows, ["k"], "ts", "n", ["id"])
    same(got.select("id", "n"), rows.select("id", F.row_number().over(order()).cast("bigint").alias("n")))


def test_neighbours(rows):
    got = O.previous_value(rows, ["k"], "ts", "v", "p", ["id"])
    same(got.select("id", "p"), rows.select("id", F.lag("v").over(order()).alias("p")))
    got = O.next_value(rows, ["k"], "ts", "v", "n", ["id"])
    same(got.select("id", "n"), rows.select("id", F.lead("v").over(order()).alias("n")))


def test_neighbour_may_be_null(spark):
    df = spark.sql("SELECT 'a' AS k, timestamp_seconds(t) AS ts, v FROM VALUES (1, 1), (2000, NULL), (4000, 3) AS x(t, v)")
    got = O.previous_value(df, ["k"], "ts", "v", "p", []).orderBy("ts")
    assert [r.p for r in got.collect()] == [None, 1, None]


def test_carry_last(rows):
    value = F.when(F.col("v") > 8, F.col("id"))
    upto = order().rowsBetween(Window.unboundedPreceding, 0)
    got = O.carry_last(rows, ["k"], "ts", value, "c", ["id"])
    same(got.select("id", "c"), rows.select("id", F.last(value, ignorenulls=True).over(upto).alias("c")))


def test_trailing_sum(rows):
    frame = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-500 * 1000000 + 1, 0)
    got = O.trailing_sum(rows, ["k"], "ts", "v", 500, "x")
    same(got.select("id", "x"), rows.select("id", F.sum("v").over(frame).alias("x")))


def test_trailing_sum_of_hot_hour_with_resets_jump_and_infinity(spark):
    """One key holds all rows, in one hour; what has left the window leaves no trace."""
    rng = random.Random(11)
    data = [("hot", rng.randrange(3600), v) for v in [0.9, 0.3, 0.2, 0.1, 1e17, float("inf")] + [rng.choice([0.1, 0.2, 0.7, 1.0]) for _ in range(2000)]]
    df = spark.createDataFrame(data, "k STRING, s INT, v DOUBLE").withColumn("ts", F.timestamp_seconds("s"))
    for r in O.trailing_sum(df, ["k"], "ts", "v", 60, "x").collect():
        want = sum(sorted(v for _, s, v in data if r.s - 60 < s <= r.s))
        assert r.x == want or abs(r.x - want) <= 1e-9 * abs(want)
    quiet = spark.createDataFrame([("a", t, v) for t, v in [(0, 0.9), (1, 0.3), (2, 1e17), (3, float("inf")), (50, 0.0), (100, 1.0)]], "k STRING, s INT, v DOUBLE")
    got = O.trailing_sum(quiet.withColumn("ts", F.timestamp_seconds("s")), ["k"], "ts", "v", 10, "x").where("s >= 50").orderBy("s")
    assert [r.x for r in got.collect()] == [0.0, 1.0]


def test_run_start(rows):
    def starts(before, now):
        return now & ~F.coalesce(before, F.lit(False))

    flag = starts(F.lag("on").over(order()), F.col("on"))
    want = rows.withColumn("f", F.when(flag, F.col("ts"))).select(
        "id", F.last("f", ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0)).alias("r")
    )
    got = O.run_start(rows, ["k"], "ts", F.col("on"), starts, "r", ["id"])
    same(got.select("id", "r"), want)


def test_as_of(spark, rows):
    marks = rows.where(F.col("v") == 3).select("k", "ts", F.col("id").alias("m"))
    got = O.as_of(rows, marks, ["k"], "ts", ["m"], ["m"]).select("id", "m").collect()
    data, best = rows.collect(), {}
    for r in data:
        found = [(q.ts, q.id) for q in data if q.k == r.k and q.v == 3 and q.ts <= r.ts]
        best[r.id] = max(found)[1] if found else None
    assert {r.id: r.m for r in got} == best


def test_as_of_keeps_rows_without_key(spark):
    rows = spark.sql("SELECT id, k, timestamp_seconds(t) AS ts FROM VALUES (1, NULL, 5), (2, 'a', NULL), (3, 'a', 9) AS x(id, k, t)")
    marks = spark.sql("SELECT k, timestamp_seconds(t) AS ts, m FROM VALUES (NULL, 1, 7), ('a', 2, 8) AS x(k, t, m)")
    got = O.as_of(rows, marks, ["k"], "ts", ["m"]).collect()
    assert {r.id: r.m for r in got} == {1: None, 2: None, 3: 8}
