"""Aggregations.  All are map-side combinable; lists are built only from rows
already reduced to distinct labels, or in bounded chunks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractum.operators.joins import mark
from tractum.operators.keys import join_null_safe
from tractum.operators.ordered import rank_within
from tractum.operators.tasks import grouped, sizing, split


def exact_mean(c: str, digits: int = 4) -> Column:
    """Mean of values with at most ``digits`` decimals, independent of row order."""
    return F.sum(F.col(c).cast(f"decimal(18,{digits})")).cast("double") / F.count(c)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column))


def weighted_counts(df: DataFrame, keys: Sequence[str], weight: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(weight).alias("weight"))


def column_stats(df: DataFrame, domains: Mapping[str, tuple[float, float]]) -> DataFrame:
    """count, nulls, sum, min, max, mean, outside-domain per column: one pass
    over the rows, then one output row per column."""
    structs = []
    for name, (lo, hi) in domains.items():
        c = F.col(name).cast("double")
        structs.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(c).alias("n"),
                F.count_if(c.isNull()).alias("nulls"),
                F.sum(c).alias("sum"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
                F.avg(c).alias("mean"),
                F.count_if((c < lo) | (c > hi)).alias("outside"),
            )
        )
    return df.agg(F.array(*structs).alias("_s")).select(F.explode("_s").alias("_s")).select("_s.*")


def quality_profile(df: DataFrame) -> DataFrame:
    """values, nulls, non-finite, negative, min, max of every numeric column,
    including the elements of numeric list columns."""
    structs = []
    for field in df.schema.fields:
        is_list = isinstance(field.dataType, T.ArrayType)
        kind = field.dataType.elementType if is_list else field.dataType
        if not isinstance(kind, T.NumericType):
            continue
        if is_list:
            items = F.transform(F.coalesce(F.col(field.name), F.array()), lambda x: x.cast("double"))
            finite = F.filter(items, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
            present = F.filter(items, lambda x: x.isNotNull())
            measures = (F.sum(F.size(present)), F.sum(F.size(items) - F.size(present)), F.sum(F.size(present) - F.size(finite)),
                        F.sum(F.size(F.filter(finite, lambda x: x < 0))), F.min(F.array_min(finite)), F.max(F.array_max(finite)))
        else:  # plain aggregates, without an array for each value
            value = F.col(field.name).cast("double")
            fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
            measures = (F.count(value), F.count_if(value.isNull()), F.count_if(value.isNotNull() & ~fine), F.count_if(fine & (value < 0)),
                        F.min(F.when(fine, value)), F.max(F.when(fine, value)))
        names = ("n_values", "nulls", "non_finite", "negative", "min", "max")
        structs.append(F.struct(F.lit(field.name).alias("column"), *[m.alias(n) for m, n in zip(measures, names)]))
    return df.agg(F.array(*structs).alias("_s")).select(F.explode("_s").alias("_s")).select("_s.*")


def weighted_channels(edges: DataFrame, keys: Sequence[str], channels: Sequence[str], weight: str = "n",
                      min_weight: int = 1) -> DataFrame:
    """Weight-averaged channels (probabilities, kept to 9 decimals) per key; the
    minimum applies after the merge.  Summed as decimals, so the result does
    not depend on the order in which shuffled rows arrive."""
    w = F.col(weight)
    means = [
        (F.sum(F.col(c).cast("decimal(12,9)") * w.cast("bigint")).cast("double") / F.sum(w)).alias(c) for c in channels
    ]
    rows = edges.select(*keys, weight, *channels)
    return grouped(rows, keys, keys, [F.sum(w).alias(weight), *means]).where(F.col(weight) >= min_weight)


def distinct_endpoints(edges: DataFrame, universe: DataFrame) -> DataFrame:
    """Exact distinct ids per direction and in total, and how many of them are
    in the universe: ids are deduplicated first, then counted."""
    roles = edges.select(F.explode(F.array(
        F.struct(F.col("pre").alias("id"), F.lit(1).alias("as_pre"), F.lit(0).alias("as_post")),
        F.struct(F.col("post").alias("id"), F.lit(0).alias("as_pre"), F.lit(1).alias("as_post")),
    )).alias("_e")).select("_e.*")
    ids = roles.groupBy("id").agg(F.max("as_pre").alias("as_pre"), F.max("as_post").alias("as_post"))
    return mark(ids, "id", universe, "known").agg(
        F.sum("as_pre").alias("n_pre"),
        F.sum("as_post").alias("n_post"),
        F.count("*").alias("n_any"),
        F.count_if("known").alias("n_in_universe"),
    )


def threshold_counts(df: DataFrame, keys: Sequence[str], column: str, limits: Sequence[float],
                     below: bool = False, prefix: str = "ge_") -> DataFrame:
    def holds(limit):
        return F.col(column) <= limit if below else F.col(column) >= limit

    aggs = [F.count_if(holds(x)).alias(f"{prefix}{x}") for x in limits]
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *aggs, F.max(column).alias("largest"))


def distinct_text(df: DataFrame, keys: Sequence[str], label: str, name: str, sep: str = ";") -> DataFrame:
    """Distinct labels per key, sorted and joined.  Rows are reduced to
    (key, label) first, so a hot key arrives as its few labels."""
    labels = df.where(F.col(label).isNotNull()).select(*keys, label).distinct()
    return labels.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(label)), sep).alias(name))


def histogram_text(df: DataFrame, keys: Sequence[str], label: str, name: str, weight: Column | None = None) -> DataFrame:
    """``label:count;...`` by descending count, then label."""
    counts = df.groupBy(*keys, label).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("neg"), F.col(label).alias("label"))))
    text = F.transform(parts, lambda p: F.concat(p["label"], F.lit(":"), (-p["neg"]).cast("string")))
    return counts.groupBy(*keys).agg(F.array_join(text, ";").alias(name))


def dominant(df: DataFrame, keys: Sequence[str], label: str, weight: Column | None = None) -> DataFrame:
    """Label with the largest count; ties go to the smallest label."""
    counts = df.groupBy(*keys, label).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("neg"), F.col(label).alias("label")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.label").alias("dominant"), (-F.col("_b.neg")).alias("n")
    )


def chunked_list(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], item: Column, name: str,
                 chunk: int = 4096, sep: str | None = ";") -> DataFrame:
    """The ordered list of a key in chunks of at most ``chunk`` items, so that a
    hub's list is neither cut nor built in one task.

    Keys that fit a task are shuffled once, numbered and cut to chunks there;
    only keys with more rows than that are laid out by range to be numbered."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_rank").alias("r"), item.alias("v")))), lambda p: p["v"])
    out = values if sep is None else F.array_join(F.transform(values, lambda v: v.cast("string")), sep)

    def lists(ranked: DataFrame) -> DataFrame:
        numbered = ranked.withColumn("chunk", F.expr(f"(_rank - 1) div {chunk}"))
        return numbered.groupBy(*keys, "chunk").agg(F.count("*").alias("n_items"), out.alias(name))

    light, heavy = split(df, keys, sizing(df, keys))
    by_key = Window.partitionBy(*keys).orderBy(*order)
    found = lists(light.withColumn("_rank", F.row_number().over(by_key).cast("long")))
    return found if heavy is None else found.unionByName(lists(rank_within(heavy, keys, order, "_rank")))


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, total: str, share: str) -> DataFrame:
    """Adds the key's total and the row's share of it.  An aggregate joined
    back, not a window: partial sums combine before the shuffle."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias(total))
    return join_null_safe(df, totals, keys).withColumn(share, F.try_divide(F.col(value).cast("double"), F.col(total)))


def group_size(df: DataFrame, keys: Sequence[str], name: str, distinct: str | None = None) -> DataFrame:
    sizes = df.groupBy(*keys).agg((F.count("*") if distinct is None else F.count_distinct(distinct)).alias(name))
    return join_null_safe(df, sizes, keys)


def degrees(edges: DataFrame, universe: DataFrame) -> DataFrame:
    """Out/in degree and weight of every node of the universe, 0 where none."""
    out = edges.groupBy(F.col("pre").alias("id")).agg(F.count("*").alias("out_degree"), F.sum("n").alias("out_weight"))
    inn = edges.groupBy(F.col("post").alias("id")).agg(F.count("*").alias("in_degree"), F.sum("n").alias("in_weight"))
    names = ["out_degree", "out_weight", "in_degree", "in_weight"]
    return universe.toDF("id").distinct().join(out, "id", "left").join(inn, "id", "left").fillna(0, names)


def condition_pivot(df: DataFrame, key: str, condition: str, value: str, conditions: Sequence[str]) -> DataFrame:
    return df.groupBy(key).pivot(condition, list(conditions)).agg(F.sum(value)).fillna(0, list(conditions))


def type_rollup(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges.groupBy(*keys).agg(
        F.sum("n").alias("contacts"),
        F.count("*").alias("n_pairs"),
        F.count_distinct("pre").alias("n_sources"),
        F.count_distinct("post").alias("n_partners"),
    )
