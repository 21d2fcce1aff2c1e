"""Mergeable sketches of distinct ids: one per part, stored, and put together
without reading the parts again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12
#: Three standard deviations of a merged sketch: 1.04 / sqrt(2 ** LG_K) each.
BOUND = 3 * 1.04 / 2 ** (LG_K / 2)


def part_sketches(df: DataFrame, parts: Sequence[str], columns: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """``parts`` and for each of ``columns`` a sketch of its distinct values in
    the part; NULL values don't count."""
    return df.groupBy(*parts).agg(*[F.hll_sketch_agg(c, F.lit(lg_k)).alias(c) for c in columns])


def merged(sketches: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One sketch per column over all rows of ``sketches`` (per ``by``)."""
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(c).alias(c) for c in columns])


def across(sketches: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Adds the sketch of the union of several columns."""
    out = F.col(columns[0])
    for c in columns[1:]:
        out = F.hll_union(out, F.col(c))
    return sketches.withColumn(name, out)


def estimates(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The estimated number of distinct values in place of each sketch."""
    return sketches.withColumns({c: F.hll_sketch_estimate(c) for c in columns})
