"""Graph build, bounded hops, path enumeration, ablation and adjacency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractum.functions.columns import clip_probability
from tractum.operators.aggs import chunked_list, weighted_channels
from tractum.operators.joins import both_in_set, in_set, mark, not_in_set
from tractum.operators.reach import hop_distance  # noqa: F401  (part of this module's interface)
from tractum.operators.strongest import strongest_paths  # noqa: F401
from tractum.session import stage

LIST = 1024  # last edges of a node that are joined as one row


def drop_accounting(edges: DataFrame, universe: DataFrame, min_weight: int = 1) -> DataFrame:
    """Rows and weight kept or dropped, by the first reason that applies."""
    marked = mark(mark(edges, "pre", universe, "_a"), "post", universe, "_b")
    reason = (
        F.when(~F.col("_a"), "pre_outside")
        .when(~F.col("_b"), "post_outside")
        .when(F.col("n") < min_weight, "low_weight")
        .otherwise("kept")
    )
    return marked.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_rows"), F.sum("n").alias("weight"))


def build_graph(edges: DataFrame, universe: DataFrame, channels: Sequence[str], min_weight: int = 1) -> DataFrame:
    """Region rows inside the universe merged to directed pairs with
    weight-averaged channels, each clipped to [0, 1] and 0 unless finite."""
    inside = both_in_set(edges.where("n > 0"), universe).withColumns({c: clip_probability(c) for c in channels})
    return weighted_channels(inside, ["pre", "post"], channels, "n", min_weight)


def connected_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("pre").alias("id")).union(edges.select(F.col("post").alias("id"))).distinct()


def isolates(edges: DataFrame, universe: DataFrame) -> DataFrame:
    return not_in_set(universe.toDF("id"), "id", connected_nodes(edges))


def isolates_by_limit(edges: DataFrame, universe: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``min_n`` and ``id`` of the nodes on no edge of that count or more, for each limit."""
    ends = F.array(F.col("pre"), F.col("post"))
    best = edges.select(F.explode(ends).alias("id"), "n").groupBy("id").agg(F.max("n").alias("_best"))
    below = F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x > F.coalesce("_best", F.lit(0)))
    return universe.toDF("id").join(best, "id", "left").select(F.explode(below).alias("min_n"), "id")


def shortest_paths(hops: DataFrame, edges: DataFrame, sources: DataFrame, max_hops: int = 4) -> DataFrame:
    """One shortest path per (source, target, min_n) by following next nodes:
    the node array and the least edge weight on it."""
    hops, edges = stage(hops), stage(edges.select("pre", "post", "n"))
    path = in_set(hops, "id", sources).select(
        "target", "min_n", F.col("id").alias("source"), "hops", F.array("id").alias("nodes"),
        F.col("next_id").alias("_at"), F.col("id").alias("_from"), F.lit(None).cast("long").alias("bottleneck"),
    )
    nexts = hops.select("target", "min_n", F.col("id").alias("_at"), F.col("next_id").alias("_then"))
    weights = edges.select(F.col("pre").alias("_from"), F.col("post").alias("_at"), F.col("n").alias("_w"))
    for _ in range(max_hops):
        path = (
            path.join(weights, ["_from", "_at"], "left")
            .join(nexts, ["target", "min_n", "_at"], "left")
            .select(
                "target", "min_n", "source", "hops",
                F.when(F.col("_at").isNull(), F.col("nodes")).otherwise(
                    F.concat("nodes", F.array("_at"))
                ).alias("nodes"),
                F.col("_then").alias("_at"), F.col("_at").alias("_from"),
                F.least("bottleneck", "_w").alias("bottleneck"),
            )
        )
    return path.drop("_at", "_from")


def reachability(hops: DataFrame, groups: DataFrame, max_hops: int = 4) -> DataFrame:
    """Per (group, target, min_n): inputs reached at each hop count and not at
    all.  ``groups``: id, grp.  Unreached inputs are group size minus reached,
    so unreached pairs are never materialised."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("inputs"))
    aggs = [F.count_if(F.col("hops") == h).alias(f"hops_{h}") for h in range(1, max_hops + 1)]
    hit = hops.join(groups, "id").groupBy("grp", "target", "min_n").agg(F.count("*").alias("_reached"), *aggs)
    return hit.join(sizes, "grp").withColumn("unreached", F.col("inputs") - F.col("_reached")).drop("_reached")


def paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, k: int, weights: Sequence[str] = ("n",),
          allowed: DataFrame | None = None, same_version_at: int | None = None) -> DataFrame:
    """Simple paths of exactly ``k`` (1..3) edges from sources to targets.

    ``weights`` names the count columns (one per version); edge i's columns
    come out as ``<weight>_i``.  Sources and targets cut the first and last
    edge set before any join, and a middle edge must start where a first edge
    ends and end where a last edge starts.  With ``same_version_at`` a path
    stays only if some version has all its edges at that count or more, which
    is also applied to each edge on the way.
    """
    if same_version_at is not None:
        present = F.greatest(*[F.coalesce(w, F.lit(0)) for w in weights]) if len(weights) > 1 else F.col(weights[0])
        edges = edges.where(present >= same_version_at)
    edges = edges.where("pre <> post")
    first = in_set(edges, "pre", sources)
    last = in_set(edges, "post", targets)
    if allowed is not None:
        first = in_set(first, "post", allowed) if k > 1 else first
        last = in_set(last, "pre", allowed) if k > 1 else last

    def named(df: DataFrame, pre: str, post: str, i: int) -> DataFrame:
        return df.select(F.col("pre").alias(pre), F.col("post").alias(post), *[F.col(w).alias(f"{w}_{i}") for w in weights])

    def one_version(df: DataFrame, upto: int) -> DataFrame:
        if same_version_at is None:
            return df
        ok = F.lit(False)
        for w in weights:
            every = F.lit(True)
            for i in range(1, upto + 1):
                every = every & (F.coalesce(F.col(f"{w}_{i}"), F.lit(0)) >= same_version_at)
            ok = ok | every
        return df.where(ok)

    if k == 1:
        return one_version(named(in_set(first, "post", targets), "source", "target", 1), 1)
    if k == 2:
        two = named(first, "source", "mid", 1).join(named(last, "mid", "target", 2), "mid")
        return one_version(two.where("source <> target"), 2)
    if k != 3:
        raise ValueError("paths are enumerated for k = 1, 2, 3")
    middle = edges if allowed is None else both_in_set(edges, allowed)
    middle = in_set(in_set(middle, "post", last.select("pre").distinct()), "pre", first.select("post").distinct())
    two = named(first, "source", "mid", 1).join(named(middle, "mid", "mid2", 2), "mid").where("source <> mid2")
    # Last edges come as lists of bounded length, so the join makes a row per list and not per path.
    third = named(last, "mid2", "target", 3)
    ends = [c for c in third.columns if c != "mid2"]
    lists = chunked_list(third, ["mid2"], ["target"], F.struct(*ends), "_ends", LIST, sep=None).select("mid2", "_ends")
    two = one_version(two, 2)
    three = two.join(lists, "mid2").select(*two.columns, F.inline("_ends")).select("mid2", *[c for c in two.columns if c != "mid2"], *ends)
    return one_version(three.where("source <> target AND mid <> target"), 3)


def top_mediator(two_edge_paths: DataFrame) -> DataFrame:
    """The mid on most paths per source; ties go to the smallest id."""
    return most_paths(two_edge_paths.groupBy("source", "mid").agg(F.count("*").alias("n_paths")))


def most_paths(counts: DataFrame) -> DataFrame:
    """The row of each source with most ``n_paths``; ties go to the smallest mid."""
    best = F.min(F.struct((-F.col("n_paths")).alias("neg"), F.col("mid").alias("mid")))
    return counts.groupBy("source").agg(best.alias("b")).select(
        "source", F.col("b.mid").alias("mid"), (-F.col("b.neg")).alias("n_paths")
    )


def ablate(two_edge_paths: DataFrame, removals: DataFrame, direct: DataFrame) -> DataFrame:
    """Effect of removing nodes from each source's reach within two edges.

    ``removals``: source, condition, node (NULL removes nothing); ``direct``:
    source, target of the edges between them, which keep a target in reach
    unless the source or the target itself is removed.  Gives, per (source,
    condition), paths and targets before and after, and the targets lost."""
    direct = direct.select("source", "target").distinct()
    per_path = two_edge_paths.groupBy("source", "target").agg(F.count("*").alias("_paths"))
    per_target = per_path.join(direct.withColumn("_direct", F.lit(1)), ["source", "target"], "full").fillna(0, ["_paths", "_direct"])
    before = per_target.groupBy("source").agg(
        F.sum("_paths").alias("paths_before"), F.count("*").alias("targets_before")
    )
    # Only removed paths are joined: those whose mid or target is the node,
    # and every path of a source that is itself removed.
    counted = two_edge_paths.select("source", "mid", "target")
    hit_mid = counted.join(removals.withColumnRenamed("node", "mid"), ["source", "mid"])
    hit_target = counted.join(removals.withColumnRenamed("node", "target"), ["source", "target"])
    hit_source = counted.join(removals.where("source = node").drop("node"), "source")
    columns = ["source", "condition", "mid", "target"]
    removed = hit_mid.select(columns).union(hit_target.select(columns)).union(hit_source.select(columns)).distinct()
    cut = direct.join(removals.withColumnRenamed("node", "target"), ["source", "target"]).select("source", "condition", "target").union(
        direct.join(removals.where("source = node").drop("node"), "source").select("source", "condition", "target")).distinct()
    losses = removed.select("source", "condition", "target", F.lit(1).alias("_path"), F.lit(0).alias("_edge")).union(
        cut.select("source", "condition", "target", F.lit(0), F.lit(1)))
    gone = losses.groupBy("source", "condition", "target").agg(F.sum("_path").alias("_gone"), F.sum("_edge").alias("_cut"))
    lost = gone.join(per_target, ["source", "target"]).groupBy("source", "condition").agg(
        F.sum("_gone").alias("_paths_gone"), F.count_if((F.col("_gone") == F.col("_paths")) & (F.col("_cut") == F.col("_direct"))).alias("targets_lost")
    )
    out = removals.select("source", "condition").distinct().join(before, "source").join(
        lost, ["source", "condition"], "left"
    ).fillna(0, ["_paths_gone", "targets_lost"])
    return out.select(
        "source", "condition", "paths_before", (F.col("paths_before") - F.col("_paths_gone")).alias("paths_after"),
        "targets_before", (F.col("targets_before") - F.col("targets_lost")).alias("targets_after"), "targets_lost",
    )


def path_edges(path_rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct directed edges used by paths given as node columns."""
    pairs = [F.struct(F.col(a).alias("pre"), F.col(b).alias("post")) for a, b in zip(columns, columns[1:])]
    return path_rows.select(F.explode(F.array(*pairs)).alias("e")).select("e.*").distinct()


def adjacency(edges: DataFrame, chunk: int = 4096) -> DataFrame:
    """Neighbour lists in chunks; a hub is split over several rows."""
    item = F.concat(F.col("post").cast("string"), F.lit(":"), F.col("n").cast("string"))
    return chunked_list(edges, ["pre"], ["post"], item, "neighbours", chunk)


def contributors(edges: DataFrame, targets: DataFrame, weight: Column) -> DataFrame:
    return in_set(edges, "post", targets).withColumn("contribution", weight).groupBy("pre").agg(
        F.sum("contribution").alias("contribution"), F.sum("n").alias("contacts")
    )
