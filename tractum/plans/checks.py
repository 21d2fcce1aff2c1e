"""Violation counts and the check ledger."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each rule, counted in one pass: (problem, n)."""
    counts = [F.struct(F.lit(k).alias("problem"), F.count_if(c).alias("n")) for k, c in rules.items()]
    return df.agg(F.array(*counts).alias("_v")).select(F.explode("_v").alias("_v")).select("_v.*")


def ledger(metrics: DataFrame, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(name, passed, expected, actual) rows from a one-row metric frame.

    ``checks``: name -> (expected, actual) as expressions over the metrics."""
    rows = [
        F.struct(
            F.lit(name).alias("name"), expected.eqNullSafe(actual).alias("passed"),
            expected.cast("long").alias("expected"), actual.cast("long").alias("actual"),
        )
        for name, (expected, actual) in checks.items()
    ]
    return metrics.select(F.explode(F.array(*rows)).alias("_c")).select("_c.*")


def require_passed(checks: DataFrame) -> DataFrame:
    failed = [r["name"] for r in checks.where("NOT passed").select("name").collect()]  # one row per named check
    if failed:
        raise ValueError(f"checks failed: {failed}")
    return checks
