"""Latency quantiles from stored, mergeable sketches.

One KLL sketch per endpoint, concurrency and hour is made where the requests are, and stored. Any range of hours, and any set of
endpoints, is then answered by merging a few hundred bytes a sketch; the raw requests are not read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 400


def rank_error(k: int = K) -> float:
    """Bound of the error of a rank, as a share of all values, that holds in 99 of 100 cases (published for these sketches)."""
    return 2.296 / k**0.9723


def latency_sketches(requests: DataFrame, k: int = K) -> DataFrame:
    """``requests(endpoint, concurrency, started_at, latency_ms)`` -> endpoint, concurrency, hour, requests, sketch. Null latencies do not count."""
    known = requests.where(F.col("latency_ms").isNotNull())
    return known.groupBy("endpoint", "concurrency", F.date_trunc("hour", "started_at").alias("hour")).agg(
        F.count("*").alias("requests"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(k)).alias("sketch")
    )


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float], k: int = K) -> DataFrame:
    """Quantiles of ``latency_sketches`` rows merged by ``keys``: one row per key and share, with the number of requests.

    A median or percentile returned here has a rank within ``rank_error(k)`` of its share."""
    merged = sketches.groupBy(*keys).agg(F.sum("requests").alias("requests"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    asked = F.array(*[F.lit(float(s)) for s in shares])
    found = F.arrays_zip(asked.alias("share"), F.kll_sketch_get_quantile_double("sketch", asked).alias("latency_ms"))
    return merged.select(*keys, "requests", F.explode(found).alias("q")).select(*keys, "requests", "q.*").toDF(*keys, "requests", "share", "latency_ms")
