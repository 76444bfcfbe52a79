import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.operators import monitoring as M

T0 = dt.datetime(2024, 3, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def samples(spark, points, series="s"):
    return spark.createDataFrame([(series, at(t), float(v)) for t, v in points], "series STRING, ts TIMESTAMP, value DOUBLE")


def test_series_name(spark):
    df = spark.sql("SELECT 'm' AS metric, map('b', '2', 'a', '1') AS labels UNION ALL SELECT 'm', map('a', '1', 'b', '2') UNION ALL SELECT 'n', NULL")
    assert sorted(r.series for r in M.with_series(df).collect()) == ['m{a=["1"],b=["2"]}', 'm{a=["1"],b=["2"]}', "n{}"]


def test_rate_with_reset_and_window_edge(spark):
    points = [(0, 10), (15, 13), (30, 20), (45, 4), (60, 9), (360, 9)]
    got = [r.rate for r in M.counter_rate(samples(spark, points), 60).orderBy("ts").collect()]
    # Increases: 0 3 7 4 5 0; the sample exactly one window back is outside.
    assert got == pytest.approx([0, 3 / 60, 10 / 60, 14 / 60, 19 / 60, 0])


def test_ratio_rule(spark):
    num = samples(spark, [(0, 0), (10, 5), (70, 5), (130, 6)], "n")
    den = samples(spark, [(0, 0), (70, 4), (130, 4)], "d")
    got = {(r.ts - T0).seconds: r for r in M.ratio_rule(num, den, 60, 0.3, ">", 30).collect()}
    assert got[30].denominator == 0 and got[30].ratio is None and not got[30].breached
    assert got[90].ratio == 0.0 and not got[90].breached
    wide = {(r.ts - T0).seconds: r for r in M.ratio_rule(num, den, 120, 0.3, ">", 30).collect()}
    assert wide[90].ratio == 1.25 and wide[90].breached


def test_no_denominator_is_not_a_breach(spark):
    num, den = samples(spark, [(0, 0), (10, 5)], "n"), samples(spark, [(0, 0), (10, 0)], "d")
    assert not any(r.breached for r in M.ratio_rule(num, den, 3600, 0.3, ">").collect())


def test_histogram_and_quantile(spark):
    df = spark.createDataFrame([(float(v),) for v in (0.05, 0.1, 0.15, 0.2, 5.0)], "x DOUBLE")
    h = M.fixed_histogram(df, "x", [0.1, 0.2, 1.0])
    assert {r.le: r.cumulative for r in h.collect()} == {0.1: 2, 0.2: 4, 1.0: 4, float("inf"): 5}
    rates = h.withColumn("rate", F.col("cumulative").cast("double"))

    def q(p):
        return M.histogram_quantile(rates, p).first().quantile

    assert q(0.4) == pytest.approx(0.1)
    assert q(0.6) == pytest.approx(0.15)
    assert q(0.99) == 1.0
    empty = rates.withColumn("rate", F.lit(0.0))
    assert M.histogram_quantile(empty, 0.5).first().quantile is None
    halves = rates.withColumn("rate", F.col("rate") / 2)
    assert M.histogram_quantile(halves.union(halves), 0.6).first().quantile == pytest.approx(0.15)


def states(points, hold):
    since, out = None, []
    for t, on in points:
        since = (t if since is None else since) if on else None
        out.append("inactive" if since is None else "firing" if t - since >= hold else "pending")
    return out


def test_alert_holds(spark):
    short = [(t, True) for t in range(0, 571, 30)]
    long = short + [(600, True), (630, False), (660, True)]
    for points in (short, long):
        df = spark.createDataFrame([("s", at(t), on) for t, on in points], "series STRING, ts TIMESTAMP, on BOOLEAN")
        got = [r.state for r in M.alert_state(df, F.col("on"), 600).orderBy("ts").collect()]
        assert got == states(points, 600)
    assert "firing" not in states(short, 600) and states(long, 600)[-3:] == ["firing", "inactive", "pending"]


def test_alert_states_of_random_series(spark):
    rng = random.Random(3)
    data = {s: [(t * 30 + rng.randrange(5), rng.random() < 0.85) for t in range(400) if rng.random() < 0.8] for s in ("a", "b")}
    df = spark.createDataFrame([(s, at(t), on) for s, p in data.items() for t, on in p], "series STRING, ts TIMESTAMP, on BOOLEAN")
    got = M.alert_state(df, F.col("on"), 120).orderBy("series", "ts").collect()
    for s, points in data.items():
        assert [r.state for r in got if r.series == s] == states(points, 120)


def test_drift_and_availability(spark):
    grown = samples(spark, [(t * 15, t * 15) for t in range(60)])  # one event per second
    got = [r.state for r in M.drift_rate(grown).orderBy("ts").collect()]
    assert got[0] == "inactive" and got[-1] == "firing"
    up = samples(spark, [(0, 1), (15, 0), (60, 0), (75, 0), (90, 1)])
    assert [r.state for r in M.availability(up).orderBy("ts").collect()] == ["inactive", "pending", "pending", "firing", "inactive"]


def test_missing_series(spark):
    df = spark.createDataFrame([(at(1), "svc", "a"), (at(2), "svc", "b"), (at(4000), "svc", "a"), (at(4000), "svc", "other")], "ts TIMESTAMP, service STRING, metric STRING")
    got = {((r.window_start - T0).seconds, r.missing_metric) for r in M.missing_series(df, ["a", "b", "c"]).collect()}
    assert got == {(0, "c"), (3600, "b"), (3600, "c")}


def test_mmd_drift_flags_a_shift(spark):
    rng = np.random.default_rng(1)
    reference = rng.normal(size=(120, 4))
    windows = np.vstack([rng.normal(size=(50, 4)), rng.normal(loc=3, size=(50, 4))])

    def table(m):
        return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "seq BIGINT, vector ARRAY<DOUBLE>")

    got = {r.window_id: r for r in M.mmd_drift(table(windows), table(reference)).collect()}
    assert not got[0].drifted and got[1].drifted and got[1].mmd2 > 10 * abs(got[0].mmd2)
    with pytest.raises(ValueError):
        M.mmd_drift(table(windows), table(reference), reference_rows=100)
