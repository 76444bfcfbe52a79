"""Metric-sample analytics: rates, ratios, quantiles, alert states, drift, series completeness.

Samples are rows ``(ts, metric, labels, value)``; ``series`` names one time series. All ordered
work goes through ``inkfold.operators.ordered``, so one hot series spreads over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.operators.ordered import previous_value, run_start, trailing_sum, with_chunk
from inkfold.schemas import REQUIRED_SERIES

COMPARE = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b,
}


def with_series(samples: DataFrame) -> DataFrame:
    """Add ``series``: the metric name and its labels in name order."""
    labels = F.array_sort(F.map_entries(F.coalesce("labels", F.create_map().cast("map<string,string>"))))
    text = F.transform(labels, lambda e: F.concat(e["key"], F.lit("="), F.to_json(F.array(e["value"]))))
    return samples.withColumn("series", F.concat("metric", F.lit("{"), F.array_join(text, ","), F.lit("}")))


def counter_increase(samples: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Add ``increase`` since the previous sample of the series. After a reset (value below the
    previous one) the new value counts; the first sample of a series adds nothing."""
    seen = previous_value(samples, keys, "ts", "value", "_prev", ["value"])
    value, before = F.col("value"), F.col("_prev")
    grown = (
        F.when(before.isNull(), 0.0).when(value < before, value).otherwise(value - before)
    )
    return seen.withColumn("increase", grown).drop("_prev")


def counter_rate(
    samples: DataFrame,
    window_seconds: int,
    keys: Sequence[str] = ("series",),
) -> DataFrame:
    """Add ``rate``: increase per second over (ts - window, ts], without extrapolation."""
    return _chunked_rate(samples, window_seconds, keys).drop("_chunk")


def _chunked_rate(samples, window_seconds, keys):
    grown = counter_increase(with_chunk(samples, keys, "ts", ["value"]), keys)
    summed = trailing_sum(grown, keys, "ts", "increase", window_seconds, "_sum")
    return summed.withColumn("rate", F.col("_sum") / window_seconds).drop("_sum", "increase")


def rate_alert(
    samples: DataFrame,
    window_seconds: int,
    threshold: float,
    op: str,
    hold_seconds: int,
    keys: Sequence[str] = ("series",),
) -> DataFrame:
    """Rate over the window, compared with the threshold, and the alert's state: both steps on
    one partitioning by (series, chunk)."""
    rated = _chunked_rate(samples, window_seconds, keys)
    condition = COMPARE[op](F.col("rate"), F.lit(threshold))
    return alert_state(rated, condition, hold_seconds, keys, ["value"]).drop("_chunk")


def stepped_increase(
    samples: DataFrame,
    step_seconds: int,
    window_seconds: int,
    keys: Sequence[str] = ("series",),
) -> DataFrame:
    """Increase over the trailing window at the end of each step that has samples. Samples are
    first reduced to one row per (series, step)."""
    grown = counter_increase(samples, keys)
    return _step_sums(grown, [*keys], {"increase": F.col("increase")}, step_seconds, window_seconds)


def _step_sums(df, keys, values, step_seconds, window_seconds):
    """Trailing-window sums of ``values`` on a grid of steps (one small row per key and step)."""
    if window_seconds % step_seconds:
        raise ValueError("the window must be a multiple of the step")
    step = F.floor(F.unix_micros("ts") / (step_seconds * 1000000)).cast("bigint")
    per_step = df.groupBy(*keys, step.alias("step")).agg(
        *[F.sum(v).alias(name) for name, v in values.items()]
    )
    n = window_seconds // step_seconds
    trailing = Window.partitionBy(*keys).orderBy("step").rangeBetween(-(n - 1), 0)
    end = F.timestamp_seconds((F.col("step") + 1) * step_seconds)
    return per_step.select(
        *keys,
        end.alias("ts"),
        *[F.sum(name).over(trailing).alias(name) for name in values],
    )


def ratio_rule(
    numerator: DataFrame,
    denominator: DataFrame,
    window_seconds: int,
    threshold: float,
    op: str,
    step_seconds: int = 30,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Ratio of two counters' increases over a trailing window and whether it breaks the rule.

    Nothing is breached where the denominator did not grow (0/0 compares false). Both inputs are
    counter samples ``(ts, series, value)``; evaluated at the end of each step with samples."""
    tagged = counter_increase(numerator).select(
        *keys, "ts", F.col("increase").alias("n"), F.lit(0.0).alias("d")
    ).unionByName(
        counter_increase(denominator).select(
            *keys, "ts", F.lit(0.0).alias("n"), F.col("increase").alias("d")
        )
    )
    sums = _step_sums(
        tagged, [*keys], {"n": F.col("n"), "d": F.col("d")}, step_seconds, window_seconds
    )
    ratio = F.when(F.col("d") > 0, F.col("n") / F.col("d"))
    return sums.select(
        *keys, "ts", F.col("n").alias("numerator"), F.col("d").alias("denominator"),
        ratio.alias("ratio"),
        F.coalesce(COMPARE[op](ratio, F.lit(threshold)), F.lit(False)).alias("breached"),
    )


def fixed_histogram(
    df: DataFrame, value: str, bounds: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Cumulative bucket counts ``le <= bound`` (plus +Inf), sum and count, in one pass."""
    x = F.col(value)
    counts = [F.count_if(x <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*keys).agg(
        *counts, F.count(x).alias("_inf"), F.sum(x).alias("sum"), F.count(x).alias("count")
    )
    buckets = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n"))
        for i, b in enumerate(bounds)
    ]
    buckets.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_inf").alias("n")))
    return wide.select(*keys, F.explode(F.array(*buckets)).alias("_b"), "sum", "count").select(
        *keys, F.col("_b.le").alias("le"), F.col("_b.n").alias("cumulative"), "sum", "count"
    )


def histogram_quantile(
    buckets: DataFrame, q: float, keys: Sequence[str] = (), value: str = "rate"
) -> DataFrame:
    """Quantile of cumulative buckets ``(keys, le, value)``, summed per bound first: linear
    inside the first bucket reaching ``q`` of the total; the highest finite bound if that is the
    +Inf bucket; null for an empty histogram. Groups are as long as the bucket list."""
    summed = buckets.groupBy(*keys, "le").agg(F.sum(value).alias("_c"))
    by_bound = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    placed = (
        summed.withColumn("_total", F.max("_c").over(whole))
        .withColumn("_below", F.coalesce(F.lag("_c").over(by_bound), F.lit(0.0)))
        .withColumn("_from", F.lag("le").over(by_bound))
    )
    le, start = F.col("le"), F.coalesce("_from", F.least(F.lit(0.0), F.col("le")))
    inside = start + (le - start) * F.try_divide(
        q * F.col("_total") - F.col("_below"), F.col("_c") - F.col("_below")
    )
    estimate = F.when(le == float("inf"), F.col("_from")).otherwise(F.coalesce(inside, start))
    reached = (F.col("_c") >= q * F.col("_total")) & (F.col("_total") > 0)
    return placed.groupBy(*keys).agg(
        F.min_by(F.when(reached, estimate), F.when(reached, le)).alias("quantile")
    )


def alert_state(
    series: DataFrame,
    condition: Column,
    hold_seconds: int,
    keys: Sequence[str] = ("series",),
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add ``active_since`` and ``state`` (inactive / pending / firing). The alert fires once the
    condition held without a false evaluation for ``hold_seconds``."""
    judged = series.withColumn("_on", F.coalesce(condition, F.lit(False)))
    dated = run_start(
        judged,
        keys,
        "ts",
        F.col("_on"),
        lambda before, now: now & ~F.coalesce(before, F.lit(False)),
        "_since",
        tie,
    )
    held = F.unix_micros("ts") - F.unix_micros("_since") >= hold_seconds * 1000000
    return dated.select(
        *series.columns,
        F.when(F.col("_on"), F.col("_since")).alias("active_since"),
        F.when(~F.col("_on"), "inactive").when(held, "firing").otherwise("pending").alias("state"),
    )


def availability(
    samples: DataFrame,
    hold_seconds: int = 60,
    keys: Sequence[str] = ("series",),
    tie: Sequence[str] = (),
) -> DataFrame:
    """Alert state of ``up == 0`` per target."""
    return alert_state(samples, F.col("value") == 0, hold_seconds, keys, tie)


def drift_rate(
    samples: DataFrame,
    threshold: float = 0.2,
    window_seconds: int = 300,
    hold_seconds: int = 120,
    keys: Sequence[str] = ("series",),
) -> DataFrame:
    """Rate of drift events over five minutes and its alert state."""
    return rate_alert(samples, window_seconds, threshold, ">", hold_seconds, keys)


def missing_series(
    samples: DataFrame,
    required: Sequence[str] = tuple(REQUIRED_SERIES),
    window: str = "1 hour",
    service: str = "service",
    services: DataFrame | None = None,
) -> DataFrame:
    """Required metric names that a service did not emit in a window between the first and the last
    sample. ``services`` lists those that should be scraped (default: all that were ever seen), so a
    service that was silent for a whole window is reported with every name."""
    start = F.window("ts", window)["start"]
    seen = samples.select(start.alias("window_start"), service, F.col("metric").alias("missing_metric")).distinct()
    wanted = samples.select(service).distinct() if services is None else services.select(service)
    span = seen.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"))
    times = span.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {window}"))).alias("window_start"))
    names = F.explode(F.array(*[F.lit(r) for r in required])).alias("missing_metric")
    # The grid of services, windows and required names, one list of windows per service.
    listed = times.agg(F.collect_list("window_start").alias("t"))
    grid = wanted.withColumn("t", listed.scalar()).select(service, F.explode("t").alias("window_start")).select("*", names)
    return grid.join(seen, ["window_start", service, "missing_metric"], "left_anti").select(
        "window_start", service, "missing_metric"
    )


def mmd_drift(
    vectors: DataFrame,
    reference: DataFrame,
    window_size: int = 50,
    bandwidth: float | None = None,
    threshold: float | None = None,
    quantile: float = 0.95,
    reference_rows: int = 500,
    resamples: int = 200,
    seed: int = 7,
) -> DataFrame:
    """Squared maximum mean discrepancy (RBF kernel, biased estimate) of each window of
    ``window_size`` consecutive vectors against a fixed reference, and a drift flag.

    ``vectors(seq, vector)``: a window is ``seq div window_size``, so no group exceeds
    ``window_size`` distinct positions. The reference may hold at most ``reference_rows`` vectors,
    which bounds what is sent to the tasks. Default bandwidth: median distance within the
    reference; default threshold: bootstrap quantile of reference against reference."""
    rows = reference.select("seq", "vector").orderBy("seq").limit(reference_rows + 1).toPandas()
    if len(rows) > reference_rows:
        raise ValueError(f"the drift reference is limited to {reference_rows} vectors")
    base = np.vstack([np.asarray(v, dtype=np.float64) for v in rows["vector"]])
    squared = _squared_distances(base, base)
    if bandwidth is None:
        bandwidth = float(np.sqrt(np.median(squared[np.triu_indices(len(base), 1)])))
    gamma = 1.0 / (2.0 * bandwidth * bandwidth)
    kernel = np.exp(-gamma * squared)
    within = float(kernel.mean())
    if threshold is None:
        rng = np.random.default_rng(seed)
        draws = []
        for _ in range(resamples):
            pick = rng.integers(0, len(base), size=min(window_size, len(base)))
            draws.append(kernel[np.ix_(pick, pick)].mean() + within - 2 * kernel[pick].mean())
        threshold = float(np.quantile(draws, quantile))
    shared = vectors.sparkSession.sparkContext.broadcast(base)

    def statistic(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        window = np.vstack([np.asarray(v, dtype=np.float64) for v in frame["vector"]])
        own = np.exp(-gamma * _squared_distances(window, window)).mean()
        cross = np.exp(-gamma * _squared_distances(window, shared.value)).mean()
        mmd2 = float(own + within - 2 * cross)
        return pd.DataFrame(
            {"window_id": [key[0]], "n": [len(window)], "mmd2": [mmd2], "drifted": [mmd2 > threshold]}
        )

    return (
        vectors.select(F.floor(F.col("seq") / window_size).alias("window_id"), "vector")
        .groupBy("window_id")
        .applyInPandas(statistic, "window_id BIGINT, n BIGINT, mmd2 DOUBLE, drifted BOOLEAN")
    )


def _squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    cross = a @ b.T
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * cross, 0.0)
