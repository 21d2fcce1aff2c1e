"""Residual explanation, filter-rule search and point-to-connection checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractum.functions.columns import align_region
from tractum.operators.aggs import chunked_list
from tractum.operators.joins import explode_endpoints, reconcile
from tractum.operators.ordered import rank_within
from tractum.operators.tasks import Size, dealt, grouped, sizing
from tractum.session import stage

PAIR = ["pre", "post"]
KEY3 = [*PAIR, "region"]
WIDE = 2


def explain_residual(raw: DataFrame, published: DataFrame, align: Callable[[str], Column] = align_region) -> DataFrame:
    """Mismatches that remain once both sides' region labels are aligned.

    Two literals of one side falling on the same aligned label would hide real
    differences, so the alignment must be one-to-one on each side or this
    raises.  ``raw`` and ``published``: pre, post, region, n.
    """
    for side, df in (("raw", raw), ("published", published)):
        labels = df.select("region", align("region").alias("aligned")).distinct()
        if not labels.groupBy("aligned").count().where("count > 1").isEmpty():
            raise ValueError(f"label alignment is not one-to-one on the {side} side")

    def aligned(df: DataFrame) -> DataFrame:
        return df.groupBy("pre", "post", align("region").alias("region")).agg(F.sum("n").alias("n"))

    return reconcile(aligned(raw), aligned(published), KEY3)


def filter_rule_search(points: DataFrame, published: DataFrame, max_size: int, exception_id: int) -> DataFrame:
    """Scores every rule (minimum size 1..max_size, and three switches) by how
    far the filtered point counts are from the published counts.

    Points are reduced to (pair, region, size) and meet the published counts
    once per region labelling.  The other two switches only drop whole keys, so
    each key is scored as kept and as dropped, summed by (is self, is
    exception), and the rules are put together from those few sums.
    """
    size = sizing(points, PAIR)
    # A key's counts are as wide as there are limits, so a task takes fewer keys.
    size = Size(size.tasks * WIDE if size.tasks > 1 else 1, size.heavy)
    sized = grouped(points.select(*KEY3, "size"), PAIR, [*KEY3, F.least("size", F.lit(max_size)).alias("size")], [F.count("*").alias("n")], size)
    labelling = F.explode(F.array(F.lit(False), F.lit(True))).alias("aligned")
    region = F.when(F.col("aligned"), align_region("region")).otherwise(F.col("region")).alias("region")
    by_limit = [F.coalesce(F.sum(F.when(F.col("size") >= t, F.col("n"))), F.lit(0)) for t in range(1, max_size + 1)]
    labelled = sized.select("*", labelling).select("aligned", "pre", "post", region, "size", "n")
    have = dealt(labelled, ["aligned", *KEY3], size).groupBy("aligned", *KEY3).agg(F.array(*by_limit).alias("counts"))
    want = dealt(published.select(*KEY3, F.col("n").alias("want"), labelling), ["aligned", *KEY3], size)
    both = have.join(want, ["aligned", *KEY3], "full")
    is_exception = (F.col("pre") == exception_id) | (F.col("post") == exception_id)
    zeros = F.array_repeat(F.lit(0).cast("long"), max_size)
    scored = both.select(
        "aligned", F.expr("pre = post").alias("is_self"), is_exception.alias("is_exception"), "want",
        F.posexplode(F.coalesce("counts", zeros)).alias("at", "have"),
    )
    wanted = F.coalesce("want", F.lit(0))
    gap = F.col("have") - wanted
    sums = scored.groupBy("aligned", "is_self", "is_exception", (F.col("at") + 1).alias("min_size")).agg(
        F.sum("have").alias("points_kept"),
        F.sum(wanted).alias("published_sum"),
        F.count_if(gap != 0).alias("key_mismatches"),
        F.sum(F.abs(gap)).alias("absolute_difference"),
        F.count_if((F.col("have") > 0) & F.col("want").isNull()).alias("point_only_keys"),
        F.count_if((F.col("have") == 0) & F.col("want").isNotNull()).alias("connection_only_keys"),
        F.count_if(wanted != 0).alias("_published_keys"),
    )
    switches = F.explode(F.array(*[
        F.struct(F.lit(a).alias("no_self"), F.lit(b).alias("no_exception")) for a in (False, True) for b in (False, True)
    ]))
    ruled = sums.select("*", switches.alias("s")).select("*", "s.*")
    dropped = F.expr("(no_self AND is_self) OR (no_exception AND is_exception)")

    def total(name: str, when_dropped: Column) -> Column:
        return F.sum(F.when(dropped, when_dropped).otherwise(F.col(name))).alias(name)

    rules = ["min_size", "no_self", "no_exception", "aligned"]
    return ruled.groupBy(*rules).agg(
        total("points_kept", F.lit(0)),
        F.sum("published_sum").alias("published_sum"),
        total("key_mismatches", F.col("_published_keys")),
        total("absolute_difference", F.col("published_sum")),
        total("point_only_keys", F.lit(0)),
        total("connection_only_keys", F.col("_published_keys")),
    ).orderBy("absolute_difference", "key_mismatches", "min_size", *[F.desc(r) for r in rules[1:]])


def point_connection_recon(points: DataFrame, connections: DataFrame, ids: DataFrame, exception_id: int) -> DataFrame:
    """Per selected node: its point rows by exclusion, and why it has points
    but no connection, if so.  ``connections``: pre, post, ... of the export."""
    flags = points.select("pre", "post", F.expr("pre = post").alias("is_self"),
                          ((F.col("pre") == exception_id) | (F.col("post") == exception_id)).alias("is_exception"))
    # A self contact is one row of its node, not two.
    ends = explode_endpoints(flags, ids).where("NOT is_self OR role = 'pre'")
    connected = explode_endpoints(connections.select("pre", "post")).select("id").distinct().withColumn("connected", F.lit(True))
    stats = ends.groupBy("id").agg(
        F.count("*").alias("n_points"), F.count_if("is_self").alias("n_self"), F.count_if("is_exception").alias("n_exception"),
        F.count_if(~F.col("is_self") & ~F.col("is_exception")).alias("n_kept"),
    )
    klass = (
        F.when(F.col("connected"), "connected").when(F.col("id") == exception_id, "exception")
        .when(F.col("n_self") == F.col("n_points"), "self_only").otherwise("other")
    )
    return stats.join(connected, "id", "left").withColumn("class", klass).drop("connected")


def region_rows(points: DataFrame, keys: Sequence[str] = KEY3) -> DataFrame:
    return grouped(points.select(*keys), [k for k in keys if k in PAIR] or keys, keys, [F.count("*").alias("n")])


def key_recon(points: DataFrame, connections: DataFrame, exception_id: int, align: Callable[[str], Column] = align_region) -> DataFrame:
    """(section, item, value) of the reconciliation by (pre, post, region) of
    points with an export of connections (pre, post, region, n), whose keys may
    repeat (views of several nodes) if their counts agree.

    ``points`` sections count rows by the first exclusion that applies: self
    contacts, then contacts of the named exception; the rest is retained, with
    aligned regions.  ``keys`` compares retained keys with the export.
    ``check`` values are 1 or 0: rows add up, repeated export rows agree, and keys
    and counts are the same."""
    pre, post, n = F.col("pre"), F.col("post"), F.col("n")
    is_self, is_exception = pre == post, (pre == exception_id) | (post == exception_id)
    blank = F.col("region").isNull() | (F.trim("region") == "")
    kind = F.when(is_self & is_exception, "self_exception").when(is_self, "self").when(is_exception, "exception").otherwise("retained")
    size = sizing(points, PAIR)
    rows = points.select(*PAIR, align("region").alias("region"), blank.alias("blank"), kind.alias("kind"))
    sums = stage(grouped(rows, PAIR, rows.columns, [F.count("*").alias("n")], size))
    # Both sides hold a few rows a key now, and lie by key for the join.
    retained = dealt(sums.where("kind = 'retained'").select(*KEY3, "n"), KEY3, size).groupBy(*KEY3).agg(F.sum("n").alias("n"))
    views = [F.min("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("views")]
    export = stage(grouped(connections.select(*KEY3, "n"), PAIR, KEY3, views, size))
    both = retained.join(dealt(export.select(*KEY3, n.alias("want")), KEY3, size), KEY3, "full")
    status = F.when(F.col("want").isNull(), "point_only").when(n.isNull(), "connection_only").when(n != F.col("want"), "different_count").otherwise("equal")
    keys = stage(both.groupBy(status.alias("item")).agg(F.count("*").alias("value")))
    figures = sums.agg(F.sum("n").alias("all"), *[F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).alias(k) for k in ("self", "self_exception", "exception", "retained")],
                       F.coalesce(F.sum(F.when(F.col("blank"), n)), F.lit(0)).alias("blank"),
                       F.coalesce(F.sum(F.when(F.col("blank") & (F.col("kind") == "retained"), n)), F.lit(0)).alias("blank_retained"))
    figures = figures.withColumns({"connections": export.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar(), "unequal_views": export.agg(F.count_if(n != F.col("most"))).scalar(),
                                   "wrong_keys": keys.agg(F.coalesce(F.sum(F.when(F.col("item") != "equal", F.col("value"))), F.lit(0))).scalar(),
                                   "exception_keys": sums.where("kind = 'exception'").select(*KEY3).distinct().agg(F.count("*")).scalar()})
    counted = ("all", "self", "self_exception", "exception", "retained", "blank", "blank_retained", "connections", "exception_keys")
    checks = {"points_add_up": F.expr("`all` = self + self_exception + exception + connections"), "views_agree": F.expr("unequal_views = 0"), "keys_and_counts_equal": F.expr("wrong_keys = 0")}
    rows = [F.struct(F.lit("points").alias("section"), F.lit(c).alias("item"), F.col(c).cast("long").alias("value")) for c in counted] + [
        F.struct(F.lit("check").alias("section"), F.lit(k).alias("item"), v.cast("long").alias("value")) for k, v in checks.items()]
    return figures.select(F.explode(F.array(*rows)).alias("r")).select("r.*").unionByName(keys.select(F.lit("keys").alias("section"), "item", "value"))


def pair_candidates(points: DataFrame, strong: DataFrame, original: DataFrame, exception_id: int, source: Column, chunk: int = 4096) -> DataFrame:
    """Pairs by region of a second detector with the points they come from, in
    order of review.

    ``points``: pre, post, region and what ``source`` (the name of a point's row)
    reads; self contacts and those of the exception are left out, regions are
    aligned.  ``strong`` (pre, post): pairs of the thresholded export;
    ``original`` (pre, post): pairs of the first detector.  Gives the key, ``n``,
    ``review_rank``, ``in_export``, ``in_original`` and the names of the points
    in chunks (``chunk``, ``n_items``, ``points``), so that no list is cut."""
    kept = points.where((F.col("pre") != F.col("post")) & (F.col("pre") != exception_id) & (F.col("post") != exception_id)).select(
        "pre", "post", align_region("region").alias("region"), source.alias("source"))
    kept = stage(kept)
    pairs = rank_within(kept.groupBy(*KEY3).agg(F.count("*").alias("n")), [], [F.desc("n"), F.asc("pre"), F.asc("post"), F.asc("region")], "review_rank")
    for df, name in ((strong, "in_export"), (original, "in_original")):
        pairs = pairs.join(df.select("pre", "post").distinct().withColumn(name, F.lit(True)), ["pre", "post"], "left").fillna(False, [name])
    return pairs.join(chunked_list(kept, KEY3, ["source"], F.col("source"), "points", chunk), KEY3)
