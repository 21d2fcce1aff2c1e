"""Mixing sources to target weights.

Words are counted per source, targets follow from the weights and a cap on
repetition, and each document is emitted floor(rate) times plus one more copy
with probability rate - floor(rate), decided by a hash of seed and document id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractum.operators.ordered import rank_within
from tractum.session import stage

CAP = 3.0
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, source: str, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``: the weights in turn over the sources by code point,
    null last.  Sources are numbered over range partitions, not in one task."""
    ranked = rank_within(sizes, [], [F.col(source).asc_nulls_last()], "_rank")
    values = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.withColumn("weight", F.element_at(values, (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))).drop("_rank")


def targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to rows with ``source_size`` and ``weight``: shares of
    the whole by weight; a source stops at ``cap`` times its size, and the
    excess is shared by weight among the others until none is above.

    Each round is one sum over the sources; a source once stopped stays so.
    Sources of size 0 get 0.
    """
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * F.lit(cap)
    level, stopped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > limit if stopped >= 0 else F.lit(False)
        n, fixed, weights = sizes.agg(F.count_if(above), F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == stopped:
            break
        stopped = n
        level = (total - (fixed or 0.0)) / weights if weights else level
    return sizes.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def plan(df: DataFrame, id_column: str, source: str, text: str, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 17) -> DataFrame:
    """All columns of ``df`` and ``_mix``: size, source_size, target (of the
    source) and copies, for every row.

    Null text has size 0; a null source is a source.  Rows with the same id
    share the draw.  An empty table gives no rows.  Building the result runs
    jobs on the per-source sums.
    """
    per_source = df.select(F.col(source).alias("_source"), word_count(F.col(text)).alias("_n")).groupBy("_source").agg(F.sum("_n").alias("source_size"))
    goals = targets(cyclic_weights(stage(per_source), "_source", weights), cap).select(
        F.struct("_source", "source_size", "target").alias("_goal"))
    goal, whole = F.col("_goal"), F.col("_goal.source_size")
    rate = F.when(whole > 0, goal["target"] / whole).otherwise(0.0)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_column)), 11) / F.lit(float(1 << 53))
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    out = F.struct(word_count(F.col(text)).alias("size"), whole.alias("source_size"), goal["target"].alias("target"), copies.cast("int").alias("copies"))
    return df.join(goals, F.col(source).eqNullSafe(goal["_source"])).withColumn("_mix", out).drop("_goal")


def mix(df: DataFrame, id_column: str, source: str, text: str, **options) -> DataFrame:
    """The rows of ``df``, each as often as its plan says."""
    planned = plan(df, id_column, source, text, **options).where("_mix.copies > 0")
    return planned.withColumn("_mix", F.explode(F.sequence(F.lit(1), F.col("_mix.copies")))).drop("_mix")
