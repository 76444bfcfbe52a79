"""Joins that keep their balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD = 1024


def left_join_sparse(left: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join for a ``key`` that many left rows lack. Rows without a key match nothing; a second
    join column, derived from ``spread_by``, keeps them from all going to one partition."""
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(SPREAD))).otherwise(
        F.lit(0)
    )
    # Always 0, but not a constant to the optimizer, which would drop it from the join key.
    zero = F.pmod(F.xxhash64(key), F.lit(1))
    return (
        left.withColumn("_salt", salt)
        .join(right.withColumn("_salt", zero), [key, "_salt"], "left")
        .drop("_salt")
    )
