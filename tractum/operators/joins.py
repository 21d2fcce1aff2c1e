"""Membership marks, version comparison, id resolution and evidence joins.

No join here carries a broadcast hint on data: Spark broadcasts a side when
its measured size is under the session's threshold and otherwise shuffles,
where AQE splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractum.functions.columns import delta_class
from tractum.operators.keys import join_null_safe
from tractum.operators.ordered import top_k


def require_columns(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if exact and list(df.columns) != list(columns):
        raise ValueError(f"header is {df.columns}, expected {list(columns)}")
    return df


def mark(df: DataFrame, column: str, ids: DataFrame, flag: str) -> DataFrame:
    """Adds a boolean: is ``column`` in the (one-column) id set?"""
    members = ids.toDF("_member").distinct()
    return df.join(members, df[column] == members["_member"], "left").withColumn(
        flag, F.col("_member").isNotNull()
    ).drop("_member")


def in_set(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    members = ids.toDF("_member")
    return df.join(members, df[column] == members["_member"], "left_semi")


def not_in_set(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    members = ids.toDF("_member")
    return df.join(members, df[column] == members["_member"], "left_anti")


def both_in_set(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return in_set(in_set(edges, "pre", ids), "post", ids)


def bipartite(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    return in_set(in_set(edges, "pre", sources), "post", targets)


def touches_set(edges: DataFrame, ids: DataFrame) -> DataFrame:
    marked = mark(mark(edges, "pre", ids, "_a"), "post", ids, "_b")
    return marked.where("_a OR _b").drop("_a", "_b")


def partner_class(edges: DataFrame, ids: DataFrame, name: str = "partner_class") -> DataFrame:
    marked = mark(mark(edges, "pre", ids, "_a"), "post", ids, "_b")
    label = (
        F.when(F.col("_a") & F.col("_b"), "both")
        .when(F.col("_a"), "only_pre")
        .when(F.col("_b"), "only_post")
        .otherwise("neither")
    )
    return marked.withColumn(name, label).drop("_a", "_b")


def version_delta(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full-outer comparison of two edge tables (each ``keys`` + ``n``, one row
    per key): both counts, delta and class.  Keys are unique on both sides, so
    no key can be hot."""
    joined = join_null_safe(a.withColumnRenamed("n", "n_a"), b.withColumnRenamed("n", "n_b"), keys, "full")
    return joined.withColumn("delta", F.coalesce("n_b", F.lit(0)) - F.coalesce("n_a", F.lit(0))).withColumn(
        "cls", delta_class("n_a", "n_b")
    )


def reconcile(raw: DataFrame, published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose raw and published counts differ, with the kind of mismatch."""
    joined = join_null_safe(raw.withColumnRenamed("n", "n_raw"), published.withColumnRenamed("n", "n_pub"), keys, "full")
    kind = F.when(F.col("n_pub").isNull(), "raw_only").when(F.col("n_raw").isNull(), "published_only").otherwise(
        "different_count"
    )
    n_raw, n_pub = F.coalesce("n_raw", F.lit(0)), F.coalesce("n_pub", F.lit(0))
    return joined.select(*keys, n_raw.alias("n_raw"), n_pub.alias("n_pub"), kind.alias("kind")).where("n_raw <> n_pub")


def key_union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of both key sets with both counts and an overlap flag."""
    joined = join_null_safe(a.withColumnRenamed("n", "_a"), b.withColumnRenamed("n", "_b"), keys, "full")
    return joined.select(
        *keys,
        F.coalesce("_a", F.lit(0)).alias("n_a"),
        F.coalesce("_b", F.lit(0)).alias("n_b"),
        (F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both"),
    )


def enrich_endpoints(edges: DataFrame, nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both ends' annotations as ``pre_*`` / ``post_*``, '' where unknown."""
    for end in ("pre", "post"):
        side = nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        edges = edges.join(side, end, "left").fillna("", [f"{end}_{c}" for c in columns])
    return edges


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                 validate: str = "many_to_one") -> DataFrame:
    """Join that first proves the key side(s) unique, or raises."""

    def assert_unique(df: DataFrame, side: str) -> None:
        if not df.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"{validate} join: {side} keys {list(on)} are not unique")

    if validate not in ("many_to_one", "one_to_many", "one_to_one"):
        raise ValueError(validate)
    if validate.endswith("to_one"):
        assert_unique(right, "right")
    if validate.startswith("one_to"):
        assert_unique(left, "left")
    return left.join(right, list(on), how)


def unpivot_ids(df: DataFrame, id_column: str, old_columns: Sequence[str]) -> DataFrame:
    """(old_id, new_id, method) rows from several old-id columns."""
    long = df.unpivot([id_column], list(old_columns), "method", "old_id")
    return long.where("old_id IS NOT NULL").select("old_id", F.col(id_column).alias("new_id"), "method").distinct()


def resolution_candidates(requests: DataFrame, crosswalk: DataFrame, priorities: Sequence[str]) -> DataFrame:
    """Per (request, method): the candidate id and whether it is the only one.

    An old id may stand for many new ones: requests meet its least and largest
    candidate only, so an id asked for often and held by many stays linear."""
    priority = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(priorities, 1))):
        priority = F.when(F.col("method") == m, i).otherwise(priority)
    ends = crosswalk.groupBy("old_id", "method").agg(F.min("new_id").alias("_least"), F.max("new_id").alias("_largest"))
    hits = requests.join(ends, "old_id").withColumn("priority", priority)
    return hits.groupBy("request_id", "method", "priority").agg(
        F.min("_least").alias("new_id"), (F.min("_least") == F.max("_largest")).alias("is_unique")
    )


def resolve_ids(requests: DataFrame, crosswalk: DataFrame, priorities: Sequence[str]) -> DataFrame:
    """First method, in priority order, with exactly one candidate wins; a
    request is in conflict when its unique candidates disagree."""
    unique = resolution_candidates(requests, crosswalk, priorities).where("is_unique")
    best = unique.groupBy("request_id").agg(
        F.min_by("new_id", "priority").alias("new_id"),
        F.min_by("method", "priority").alias("method"),
        (F.min("new_id") != F.max("new_id")).alias("conflict"),
    )
    return requests.select("request_id").distinct().join(best, "request_id", "left").select(
        "request_id", "new_id", F.coalesce("method", F.lit("unresolved")).alias("method"),
        F.coalesce("conflict", F.lit(False)).alias("conflict"),
    )


def exact_site_matches(a: DataFrame, b: DataFrame, keys: Sequence[str], coordinates: Sequence[str]) -> DataFrame:
    """Per key: sum of min(count_a, count_b) over identical coordinate tuples."""
    full = [*keys, *coordinates]
    ca = a.groupBy(*full).agg(F.count("*").alias("_na"))
    cb = b.groupBy(*full).agg(F.count("*").alias("_nb"))
    return join_null_safe(ca, cb, full).groupBy(*keys).agg(F.sum(F.least("_na", "_nb")).alias("exact_sites"))


def explode_endpoints(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per selected endpoint: ``id``, ``partner`` and its ``role``."""
    ends = F.explode(
        F.array(
            F.struct(F.col("pre").alias("id"), F.col("post").alias("partner"), F.lit("pre").alias("role")),
            F.struct(F.col("post").alias("id"), F.col("pre").alias("partner"), F.lit("post").alias("role")),
        )
    )
    rest = [c for c in edges.columns if c not in ("pre", "post")]
    out = edges.select(ends.alias("_e"), *rest).select("_e.*", *rest)
    return out if ids is None else in_set(out, "id", ids)


def attach_claims(claims: DataFrame, universe: DataFrame) -> DataFrame:
    """Claims with ``exact_match``; unmatched claims stay, marked."""
    return mark(claims, "root_id", universe, "exact_match")


def project_cohort(group_rows: DataFrame, members: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   k: int) -> DataFrame:
    """Each cohort's top ``k`` rows copied to each member id of the cohort."""
    return members.join(top_k(group_rows, keys, order, k), list(keys))
