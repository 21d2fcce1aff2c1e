"""Ranks, lags and running sums that never put one group into one task.

A plain ``row_number() OVER (PARTITION BY key ORDER BY ...)`` sends every row
of a key to one task.  Here the rows are range-partitioned by (keys, order)
once, so a hot key is spread over many partitions; each partition numbers its
own rows, and a table with at most one row per partition carries the count,
sum or last row over from the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractum.operators.keys import join_null_safe
from tractum.session import stage

_POS, _PART = "_pos", "_part"


class Ordered:
    """``df`` laid out in (keys, order) order and staged: building it runs jobs
    and writes a table to the shared folder.

    ``order`` must be a total order within a key for repeatable results.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]):
        self.keys = list(keys)
        layout = [F.col(k) for k in self.keys] + [F.col(c) if isinstance(c, str) else c for c in order]
        # monotonically_increasing_id is (partition << 33) + row, i.e. the
        # global position in the sorted layout; staging fixes it for good.
        self.rows = stage(
            df.repartitionByRange(*layout)
            .sortWithinPartitions(*layout)
            .withColumn(_POS, F.monotonically_increasing_id())
        ).withColumn(_PART, F.shiftright(_POS, 33))
        self.window = Window.partitionBy(*self.keys, _PART).orderBy(_POS)

    def _carried(self, aggregate: Column, combine) -> DataFrame:
        """What earlier partitions hold of a key, for each partition in which
        the key continues.  Only a partition's first key can continue, so this
        has at most one row per partition."""
        parts = self.rows.groupBy(*self.keys, _PART).agg(aggregate.alias("_own"))
        before = Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy(_PART)
        carried = parts.withColumn("_carry", combine(before)).where(F.col("_carry").isNotNull())
        renamed = [F.col(k).alias(f"_c_{k}") for k in self.keys]
        return F.broadcast(carried.select(*renamed, F.col(_PART).alias("_c_part"), "_carry"))

    def _with_carry(self, aggregate: Column, combine) -> DataFrame:
        carried = self._carried(aggregate, combine)
        same = F.col(_PART) == F.col("_c_part")
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
        return self.rows.join(carried, same, "left")

    def _clean(self, df: DataFrame) -> DataFrame:
        return df.drop(_POS, _PART, "_carry", "_c_part", *[f"_c_{k}" for k in self.keys])

    def rank(self, name: str = "rank") -> DataFrame:
        def combine(before):
            return F.sum("_own").over(before.rowsBetween(Window.unboundedPreceding, -1))

        own = F.row_number().over(self.window).cast("long")
        df = self._with_carry(F.count("*"), combine)
        return self._clean(df.withColumn(name, own + F.coalesce(F.col("_carry"), F.lit(0))))

    def running_sum(self, value: str, name: str) -> DataFrame:
        def combine(before):
            return F.sum("_own").over(before.rowsBetween(Window.unboundedPreceding, -1))

        own = F.sum(value).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        df = self._with_carry(F.sum(value), combine)
        return self._clean(df.withColumn(name, own + F.coalesce(F.col("_carry"), F.lit(0))))

    def lag(self, columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
        """Adds ``prefix + column`` from the preceding row of the key (NULL on
        the first)."""
        packed = F.struct(*columns)

        def combine(before):
            return F.lag("_own").over(before)

        df = self._with_carry(F.max_by(packed, _POS), combine)
        df = df.withColumn("_prev", F.coalesce(F.lag(packed).over(self.window), F.col("_carry")))
        for c in columns:
            df = df.withColumn(prefix + c, F.col(f"_prev.{c}"))
        return self._clean(df.drop("_prev"))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    return Ordered(df, keys, order).rank(name)


def lag_within(df: DataFrame, keys, order, columns, prefix: str = "prev_") -> DataFrame:
    return Ordered(df, keys, order).lag(columns, prefix)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each key.

    ``row_number() <= k`` lets Spark cut each map task's groups to ``k`` rows
    before the shuffle (WindowGroupLimit), so a hot key arrives small.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, per key.

    Rows are first reduced to (key, value, count); positions are then found on
    the running count, so no task holds a whole group's values.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cum = Ordered(counted, keys, [value]).running_sum("_n", "_upto")
    totals = cum.groupBy(*keys).agg(F.max("_upto").alias("_total"))
    cum = join_null_safe(cum, totals, keys) if keys else cum.withColumn("_total", totals.scalar())
    first = F.col("_upto") - F.col("_n")
    aggs = [F.max("_total").alias("n"), F.min(value).alias("min"), F.max(value).alias("max")]
    for name, p in fractions.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        for end, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((first <= at) & (at < F.col("_upto")), F.col(value))).alias(f"_{name}_{end}"))
    out = cum.groupBy(*keys).agg(*aggs)
    for name, p in fractions.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out = out.withColumn(name, lo + (hi - lo) * (pos - F.floor(pos)))
    return out.drop(*[f"_{n}_{e}" for n in fractions for e in ("lo", "hi")])


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "upper_median") -> DataFrame:
    """The value at 0-based position n div 2 of each key's sorted values; NULL
    values don't count, a NULL key is a key."""
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    cum = Ordered(counted, keys, ["_value"]).running_sum("_n", "_upto")
    # The total is the largest running count of the key.
    totals = cum.groupBy(*keys).agg(F.max("_upto").alias("_total"))
    middle = F.expr("_total div 2")
    hit = (F.col("_upto") - F.col("_n") <= middle) & (middle < F.col("_upto"))
    return join_null_safe(cum, totals, keys).where(hit).select(*keys, F.col("_total").alias("n"), F.col("_value").alias(name))


def weighted_decay(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, smoothing: float,
                   name: str = "ewma") -> DataFrame:
    """Final state of ``a += s * (x - a)`` (a = 0 at the start) per key.

    The recurrence unrolls to sum(s * (1-s)^(n-i) * x_i): a ranked, map-side
    combined sum instead of a fold over one collected list.
    """
    newest_first = [F.col(c).desc() if isinstance(c, str) else c for c in order]
    ranked = rank_within(df, keys, newest_first, "_age")
    weight = F.lit(smoothing) * F.pow(F.lit(1.0 - smoothing), F.col("_age") - 1)
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.sum(weight * F.col(value)).alias(name)
    )


def trailing_sum(df: DataFrame, keys: Sequence[str], t: str, value: str, width: int, name: str) -> DataFrame:
    """Sum over the causal window (t - width, t] for each distinct (key, t).

    Time is cut into blocks of one window width.  After summing per (key, t)
    a block holds at most ``width`` distinct integer times, and it only needs
    the block before it as a halo: a group has at most ``2 * width`` rows
    however many samples the key has.
    """
    keys = list(keys)
    summed = df.groupBy(*keys, t).agg(F.sum(value).alias("_v"))
    own = F.floor(F.col(t) / F.lit(width))
    blocks = summed.withColumn("_block", F.explode(F.array(own, own + 1))).withColumn("_halo", F.col("_block") != own)
    w = Window.partitionBy(*keys, "_block").orderBy(t).rangeBetween(-(width - 1), 0)
    return blocks.withColumn(name, F.sum("_v").over(w)).where(~F.col("_halo")).select(*keys, t, name)
