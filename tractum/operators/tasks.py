"""Aggregates by key in tasks whose number grows with the rows.

The session fixes the number of shuffle partitions, so the keys that one task
of a plain aggregate holds grow with the input.  Here rows are dealt to as many
tasks as their number asks for; keys with too many rows for one task
are summed apart, where each map task reduces them first.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 500_000
BUCKETS = 65_536


class Size(NamedTuple):
    """``tasks`` by the number of rows, and the buckets of keys that are too large for one."""

    tasks: int = 1
    heavy: tuple[int, ...] = ()


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_TASK))


def sizing(df: DataFrame, keys: Sequence[str]) -> Size:
    """Counts the rows of ``df`` by buckets of ``keys``: one pass, one row back.
    A bucket is heavy above a task's rows (or four times the mean, where all are)."""
    counts = df.groupBy(_bucket(keys).alias("bucket")).agg(F.count("*").alias("n"))
    heavy = F.filter(F.collect_list(F.struct("bucket", "n")), lambda b: b["n"] > F.greatest(F.lit(ROWS_PER_TASK), F.sum("n") / BUCKETS * 4))
    found = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.transform(heavy, lambda b: b["bucket"]).alias("heavy")).first()
    return Size(tasks_for(found["rows"]), tuple(found["heavy"]))


def dealt(df: DataFrame, keys: Sequence[str], size: Size) -> DataFrame:
    """``df`` in the tasks of ``size``, by ``keys``.  For rows of which no key has many."""
    return df if size.tasks == 1 else df.repartition(size.tasks, *keys)


def split(df: DataFrame, keys: Sequence[str], size: Size) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys that fit a task, in the tasks of ``size``, and the others, if there are any."""
    if not size.heavy:
        return dealt(df, keys, size), None
    heavy = F.coalesce(_bucket(keys).isin(*size.heavy), F.lit(False))
    return dealt(df.where(~heavy), keys, size), df.where(heavy)


def grouped(df: DataFrame, keys: Sequence[str], by: Sequence[Column | str], aggregates: Sequence[Column], size: Size | None = None) -> DataFrame:
    """``df.groupBy(*by).agg(*aggregates)`` in the tasks of ``size`` (taken from
    ``df`` if not given).  ``keys`` must be fixed by ``by``; the result lies by ``keys``, so
    that joins and aggregates on them need no further shuffle."""
    size = sizing(df, keys) if size is None else size
    light, heavy = split(df, keys, size)
    out = light.groupBy(*by).agg(*aggregates)
    return out if heavy is None else out.unionByName(heavy.groupBy(*by).agg(*aggregates))
