"""Joins in which NULL is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` in which NULL equals NULL; each key appears once."""
    keys = list(keys)
    if not keys:
        return left.join(right, how=how)
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [left[k].eqNullSafe(other[f"_right_{k}"]) for k in keys])
    left = left.withColumn("_here", F.lit(True)) if how == "full" else left
    joined = left.join(other, on, how)
    if how == "full":  # a row of the right side alone has its keys there
        joined = joined.withColumns({k: F.when(F.col("_here"), F.col(k)).otherwise(F.col(f"_right_{k}")) for k in keys}).drop("_here")
    return joined.drop(*[f"_right_{k}" for k in keys])
