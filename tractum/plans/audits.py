"""Table audit, edge-list audit, version comparison and node catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractum.functions.columns import delta_class, first_text
from tractum.operators.aggs import distinct_endpoints, distinct_text
from tractum.operators.joins import attach_claims, both_in_set, enrich_endpoints, mark, partner_class, version_delta
from tractum.operators.graph import connected_nodes
from tractum.plans.checks import ledger
from tractum.session import stage

PAIR, KEY3 = ["pre", "post"], ["pre", "post", "region"]


def _long(df: DataFrame, metric: str, label: str, value: str) -> DataFrame:
    return df.select(F.lit(metric).alias("metric"), F.col(label).cast("string").alias("label"), F.col(value).cast("long").alias("value"))


def table_audit(points: DataFrame, universe: DataFrame, top: int = 10) -> DataFrame:
    """(metric, label, value) rows: totals, regions, membership, distinct ids
    and heaviest nodes.  The points are read once, into (pair, region) sums
    that are staged; every other figure comes from those."""
    sums = stage(points.groupBy(*KEY3).agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.count_if(~F.col("prob").between(0.0, 1.0)).alias("outside")))
    totals = sums.agg(
        F.sum("n").alias("rows"), F.sum("size").alias("size"), F.sum("outside").alias("prob_outside"),
        F.coalesce(F.sum(F.when(F.expr("pre = post"), F.col("n"))), F.lit(0)).alias("self"))
    ends = distinct_endpoints(sums, universe)
    parts = [
        _long(totals.unpivot([], ["rows", "size", "prob_outside", "self"], "l", "v"), "total", "l", "v"),
        _long(sums.groupBy("region").agg(F.sum("n").alias("v")), "region", "region", "v"),
        _long(partner_class(sums, universe, "l").groupBy("l").agg(F.sum("n").alias("v")), "membership", "l", "v"),
        _long(ends.unpivot([], ends.columns, "l", "v"), "distinct", "l", "v"),
    ]
    for end in PAIR:
        heavy = sums.groupBy(end).agg(F.sum("n").alias("v")).orderBy(F.desc("v"), F.asc(end)).limit(top)
        parts.append(_long(heavy, f"top_{end}", end, "v"))
    return reduce(DataFrame.unionByName, parts)


def edgelist_audit(edges: DataFrame, name: str, universe: DataFrame) -> DataFrame:
    """One row of counts for one version's edge list."""
    basic = edges.agg(
        F.lit(name).alias("version"), F.count("*").alias("n_pairs"), F.sum("n").alias("weight"), F.min("n").alias("min_n"),
        F.max("n").alias("max_n"), F.count_if(F.expr("pre = post")).alias("n_self"))
    ends = stage(distinct_endpoints(edges, universe))
    return basic.select("*", *[ends.select(c).scalar().alias(c) for c in ends.columns]).withColumn(
        "n_missing", F.col("n_any") - F.col("n_in_universe"))


def most_changed_pairs(rows_a: DataFrame, rows_b: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """The ``top`` pairs whose count changed most between two versions, between
    nodes connected in the first, with both annotations and the regions of the
    second.  The pairs are cut to ``top`` before anything is attached to them.

    ``rows_*``: pre, post, region, n.
    """
    def pairs(df: DataFrame) -> DataFrame:
        return df.groupBy(*PAIR).agg(F.sum("n").alias("n"))

    a = pairs(rows_a)
    delta = version_delta(a, pairs(rows_b), PAIR)
    inside = both_in_set(delta, connected_nodes(a))
    chosen = inside.orderBy(F.abs("delta").desc(), F.asc("pre"), F.asc("post")).limit(top)
    regions = distinct_text(rows_b.join(chosen.select(*PAIR), PAIR, "left_semi"), PAIR, "region", "regions")
    annotated = enrich_endpoints(chosen, nodes, ["cell_type", "super_class", "side"])
    return annotated.join(regions, PAIR, "left").fillna("", ["regions"])


def version_audit(rows_a: DataFrame, rows_b: DataFrame) -> DataFrame:
    """The whole comparison of two versions: (section, item, n_keys, n_a, n_b).

    Sections: ``region`` and ``pair`` (keys and contacts per class), ``node``
    (in which version a node has edges), ``new_pair`` (pairs of the second
    version alone by contacts, if both ends have edges in the first; else
    ``touches_isolate``) and ``check`` (n_a expected, n_b found; n_keys is 1
    if they are equal).  Each input is read once, into a staged comparison per
    region, from which all else comes.  ``rows_*``: pre, post, region, n.
    """
    regions = stage(version_delta(rows_a, rows_b, KEY3))
    both = regions.groupBy(*PAIR).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    pairs = stage(both.withColumn("cls", delta_class("n_a", "n_b")))
    keys, of_a, of_b = F.count("*").alias("n_keys"), F.coalesce(F.sum("n_a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("n_b"), F.lit(0)).alias("n_b")

    def section(name: str, df: DataFrame, item) -> DataFrame:
        return df.groupBy(item.alias("item")).agg(keys, of_a, of_b).select(F.lit(name).alias("section"), "item", "n_keys", "n_a", "n_b")

    ends = pairs.select(F.explode(F.array(*PAIR)).alias("id"), F.col("n_a").isNotNull().cast("int").alias("a"), F.col("n_b").isNotNull().cast("int").alias("b"))
    nodes = stage(ends.groupBy("id").agg(F.max("a").alias("n_a"), F.max("b").alias("n_b")))
    where = F.when(F.expr("n_a = 1 AND n_b = 1"), "both").when(F.col("n_a") == 1, "only_a").otherwise("only_b")
    new = pairs.where("cls = 'only_b'")
    for end in PAIR:
        new = mark(new, end, nodes.where("n_a = 1").select("id"), f"_{end}")
    bucket = F.when(~(F.col("_pre") & F.col("_post")), "touches_isolate").when(F.col("n_b") >= 10, "10+").when(F.col("n_b") >= 5, "5-9").when(
        F.col("n_b") >= 2, "2-4").otherwise("1")
    parts = stage(reduce(DataFrame.unionByName, [
        section("region", regions, F.col("cls")), section("pair", pairs, F.col("cls")), section("node", nodes, where), section("new_pair", new, bucket)]))

    def total(name: str, value: str, item: str | None = None):
        chosen = F.col("section") == name
        return F.coalesce(F.sum(F.when(chosen if item is None else chosen & (F.col("item") == item), F.col(value))), F.lit(0))

    checks = {
        "contacts_a": (total("region", "n_a"), total("pair", "n_a")), "contacts_b": (total("region", "n_b"), total("pair", "n_b")),
        "new_pairs_partition": (total("pair", "n_keys", "only_b"), total("new_pair", "n_keys")),
    }
    named = ledger(parts.agg(*[v.alias(f"{k}_{side}") for k, both in checks.items() for side, v in zip("ef", both)]),
                   {k: (F.col(f"{k}_e"), F.col(f"{k}_f")) for k in checks})
    rows = named.select(F.lit("check").alias("section"), F.col("name").alias("item"), F.col("passed").cast("long").alias("n_keys"),
                        F.col("expected").alias("n_a"), F.col("actual").alias("n_b"))
    return parts.unionByName(rows)


def node_catalog(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """One row per node with its claims and a display name; the node count is
    kept.  ``nodes``: id, name; ``claims``: claim_id, root_id, source_id, label."""
    seen = attach_claims(claims, nodes.select("id")).where("exact_match").groupBy("root_id", "label").agg(
        F.min("claim_id").alias("first"), F.count("*").alias("n"))
    per_node = seen.groupBy(F.col("root_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("first", "label"))).alias("_l"), F.sum("n").alias("n_claims"))
    labels = F.array_join(F.transform("_l", lambda x: x["label"]), "|")
    sources = distinct_text(claims.select(F.col("root_id").alias("id"), "source_id"), ["id"], "source_id", "sources", "|")
    df = nodes.join(per_node.select("id", labels.alias("labels"), "n_claims"), "id", "left").join(sources, "id", "left")
    return df.select(
        "id", first_text("name", "labels", F.concat(F.lit("node "), F.col("id").cast("string"))).alias("display_name"),
        F.coalesce("labels", F.lit("unknown")).alias("labels"), F.coalesce("sources", F.lit("")).alias("sources"),
        F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


def unmatched_claims(claims: DataFrame, universe: DataFrame) -> DataFrame:
    return mark(claims, "root_id", universe, "exact_match").where("NOT exact_match").drop("exact_match")


def annotation_coverage(nodes: DataFrame, labels: list[str], universe: DataFrame | None, top: int = 30) -> DataFrame:
    """(metric, label, value) rows: rows, unique and repeated ids, ids in the
    universe, the share of rows and of the universe that is covered, named
    types, and the ``top`` values of each label column with blanks as
    ``(missing)``.  Without a universe its figures are NULL."""
    def missing(c: str) -> Column:
        return F.when(F.col(c).isNull() | (F.trim(c) == ""), "(missing)").otherwise(F.col(c))

    per_id = nodes.groupBy("id").agg(F.count("*").alias("n"))
    known = None if universe is None else universe.toDF("id").distinct()
    marked = per_id.withColumn("known", F.lit(None).cast("boolean")) if known is None else mark(per_id, "id", known, "known")
    size = F.lit(None).cast("long") if known is None else known.agg(F.count("*")).scalar()
    totals = marked.agg(F.sum("n").alias("rows"), F.count("*").alias("unique"), F.sum(F.col("n") - 1).alias("repeated"),
                        F.sum(F.when(F.col("known"), F.col("n")).when(F.col("known").isNotNull(), 0)).alias("matched"),
                        F.sum(F.col("known").cast("long")).alias("known")).withColumn("size", size)
    named = totals.select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), v.cast("double").alias("value")) for k, v in {
        "rows": F.col("rows"), "unique_ids": F.col("unique"), "repeated_rows": F.col("repeated"), "matched_rows": F.col("matched"),
        "matched_share_of_rows": F.try_divide(F.col("matched").cast("double"), F.col("rows")), "annotated_share_of_universe": F.try_divide(F.col("known").cast("double"), F.col("size"))}.items()])).alias("e"))
    parts = [named.select(F.lit("coverage").alias("metric"), "e.label", "e.value")]
    for c in labels:
        counts = nodes.groupBy(missing(c).alias("label")).agg(F.count("*").cast("double").alias("value")).orderBy(F.desc("value"), "label").limit(top)
        parts.append(counts.select(F.lit(c).alias("metric"), "label", "value"))
    return reduce(DataFrame.unionByName, parts)


def cross_checks(figures: DataFrame, checks: list[tuple[str, str, tuple[str, str], tuple[str, str]]]) -> DataFrame:
    """(name, passed, n_left, n_right, n_unequal) for each check between two
    figures.  ``figures``: product, figure, item (NULL for a total), value,
    complete.  A check is (name, 'equal' or 'at_most', (product, figure),
    (product, figure)); items are compared one by one, and one missing on a side
    counts 0.  ``passed`` is NULL if a side was not scanned completely or has no
    figure at all: a partial scan proves nothing."""
    sides = [F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(side).alias("side"), F.lit(product).alias("product"), F.lit(figure).alias("figure"))
             for name, kind, left, right in checks for side, (product, figure) in (("left", left), ("right", right))]
    asked = figures.sparkSession.range(1).select(F.explode(F.array(*sides)).alias("s")).select("s.*")
    rows = asked.join(figures, ["product", "figure"], "left")
    def of(side: str, value: Column) -> Column:
        return F.when(F.col("side") == side, value)
    per_item = rows.groupBy("name", "kind", "item").agg(
        *[F.sum(of(s, F.col("value"))).alias(s) for s in ("left", "right")], *[F.min(of(s, F.coalesce(F.col("complete"), F.lit(False)))).alias(f"{s}_done") for s in ("left", "right")],
        *[F.count(of(s, F.col("value"))).alias(f"{s}_n") for s in ("left", "right")])
    zero = F.lit(0)
    holds = F.when(F.col("kind") == "equal", F.coalesce("left", zero) == F.coalesce("right", zero)).otherwise(F.coalesce("left", zero) <= F.coalesce("right", zero))
    whole = per_item.groupBy("name").agg(F.sum("left").alias("n_left"), F.sum("right").alias("n_right"), F.count_if(~holds).alias("n_unequal"),
                                         *[F.min(f"{s}_done").alias(f"{s}_done") for s in ("left", "right")], *[F.sum(f"{s}_n").alias(f"{s}_n") for s in ("left", "right")])
    sure = F.col("left_done") & F.col("right_done") & (F.col("left_n") > 0) & (F.col("right_n") > 0)
    return whole.select("name", F.when(sure, F.col("n_unequal") == 0).alias("passed"), F.when(sure, F.col("n_left")).alias("n_left"), F.when(sure, F.col("n_right")).alias("n_right"),
                        F.when(sure, F.col("n_unequal")).alias("n_unequal"))
