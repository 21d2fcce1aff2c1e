"""Set relations between id sets, labelled unions and stratified sampling."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractum.functions.columns import fnv1a
from tractum.operators.keys import join_null_safe


def union_labelled(frames: Mapping[str, DataFrame], label: str) -> DataFrame:
    parts = [df.withColumn(label, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each id once, with whether it is in ``a`` and in ``b``."""
    both = a.toDF("id").select("id", F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(
        b.toDF("id").select("id", F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    return both.groupBy("id").agg((F.max("_a") == 1).alias("in_a"), (F.max("_b") == 1).alias("in_b"))


def both_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    sides = _sides(a, b).where("in_a <> in_b")
    return sides.select(F.when(F.col("in_a"), "only_a").otherwise("only_b").alias("side"), "id")


def relations(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: is A in B, B in A, are they disjoint."""
    return _sides(a, b).agg(
        (F.count_if(F.expr("in_a AND NOT in_b")) == 0).alias("a_in_b"),
        (F.count_if(F.expr("in_b AND NOT in_a")) == 0).alias("b_in_a"),
        (F.count_if(F.expr("in_a AND in_b")) == 0).alias("disjoint"),
    )


def partition_check(groups: DataFrame, universe: DataFrame) -> DataFrame:
    """Are the groups (id, grp) exhaustive and disjoint over the universe?"""
    per_id = groups.groupBy("id").agg((F.min("grp") != F.max("grp")).alias("_overlap"))
    ids = universe.toDF("id").distinct().withColumn("_known", F.lit(True))
    return ids.join(per_id.withColumn("_covered", F.lit(True)), "id", "full").agg(
        F.count("_known").alias("n_universe"),
        F.count("_covered").alias("n_covered"),
        F.count_if("_overlap").alias("n_overlapping"),
        F.count_if(F.col("_covered").isNull()).alias("n_uncovered"),
    )


def stratified_sample(df: DataFrame, category: str, id_column: str, full_limit: int, stride: int) -> DataFrame:
    """All rows of classes with at most ``full_limit`` rows; of larger classes
    those whose id hashes to 0 modulo ``stride``.  The class sizes are a small
    aggregate joined back; the rows themselves are not shuffled by class."""
    sizes = df.groupBy(category).agg(F.count("*").alias("_size"))
    keep = (F.col("_size") <= full_limit) | (fnv1a(id_column) % stride == 0)
    return join_null_safe(df, sizes, [category]).where(keep).drop("_size")
