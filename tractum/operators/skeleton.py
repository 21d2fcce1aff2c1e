"""Skeleton trees stored as parent pointers: topology, cable and site distances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractum.functions.columns import distance, joint_rms, segment_distance
from tractum.operators.nearest import nearest_within

XYZ = ("x", "y", "z")
ANCHORS = [f"a{a}" for a in XYZ]


# The distances once more over NumPy columns, term by term in the same order, so that they are the same to the last bit.
def _squares(a, b):
    x, y, z = (p - q for p, q in zip(a, b))
    return x * x + y * y + z * z


def _node_distance(q, c):
    return np.sqrt(_squares([q[a] for a in ANCHORS], [c[a] for a in ANCHORS]))


def _segment_distance(q, c):
    site, child, parent = [q[a] for a in ANCHORS], [c["c" + a] for a in XYZ], [c["p" + a] for a in XYZ]
    step = [b - a for a, b in zip(child, parent)]
    dot, length2 = None, None
    for p, a, s in zip(site, child, step):
        dot = (p - a) * s if dot is None else dot + (p - a) * s
        length2 = s * s if length2 is None else length2 + s * s
    with np.errstate(invalid="ignore", divide="ignore"):
        t = np.where(length2 == 0, 0.0, dot / length2)
    t = np.minimum(np.maximum(t, 0.0), 1.0)
    return np.sqrt(_squares(site, [a + t * s for a, s in zip(child, step)]))


def _contact_distance(q, c):
    total = None
    for e in ("pre", "post"):
        for a in XYZ:
            d = q[f"{e}_{a}"] - c[f"{e}_{a}"]
            total = d * d if total is None else total + d * d
    return np.sqrt(total / 2)


def with_parent(tree: DataFrame) -> DataFrame:
    """Each node with its parent's coordinates (NULL for roots and orphans)."""
    parent = tree.select(
        "neuron", F.col("node_id").alias("parent_id"), *[F.col(a).alias(f"p{a}") for a in XYZ], F.lit(True).alias("found")
    )
    return tree.join(parent, ["neuron", "parent_id"], "left")


def topology(tree: DataFrame) -> DataFrame:
    """Nodes, roots, orphans and cable length per neuron.  Lengths are added as
    decimals, so the sum does not depend on row order."""
    step = distance(XYZ, [f"p{a}" for a in XYZ]).cast("decimal(18,4)")
    return with_parent(tree).groupBy("neuron").agg(
        F.count("*").alias("n_nodes"),
        F.count_if(F.col("parent_id") == -1).alias("n_roots"),
        F.count_if((F.col("parent_id") != -1) & F.col("found").isNull()).alias("n_orphans"),
        F.count("found").alias("n_segments"),
        F.coalesce(F.sum(step).cast("double"), F.lit(0.0)).alias("cable"),
    )


def geometry(tree: DataFrame) -> DataFrame:
    spans = [(F.max(a) - F.min(a)).alias(f"span_{a}") for a in XYZ]
    df = tree.groupBy("neuron").agg(
        F.count("*").alias("n_nodes"),
        F.min("radius").alias("radius_min"),
        F.max("radius").alias("radius_max"),
        F.count_if(F.col("radius") == 0).alias("radius_zero"),
        F.count_if(F.col("radius") < 0).alias("radius_negative"),
        *spans,
    )
    diagonal = F.sqrt(sum((F.col(f"span_{a}") * F.col(f"span_{a}") for a in XYZ[1:]), F.col("span_x") * F.col("span_x")))
    return df.withColumn("diagonal", diagonal)


def nearest_node(sites: DataFrame, tree: DataFrame, site_id: Sequence[str]) -> DataFrame:
    """Per site the closest node of its own neuron."""
    anchors = [F.col(a).alias(f"a{a}") for a in XYZ]
    q = sites.select("*", *anchors)
    c = tree.select("neuron", "node_id", *anchors, F.lit(0.0).alias("rad"))

    def dist(a, b):
        return distance([a[f"a{x}"] for x in XYZ], [b[f"a{x}"] for x in XYZ])

    return nearest_within(q, c, ["neuron"], site_id, "node_id", dist, [], numeric=(_node_distance, ANCHORS, ANCHORS))


def nearest_segment(sites: DataFrame, tree: DataFrame, site_id: Sequence[str]) -> DataFrame:
    """Per site the closest parent-child segment of its neuron, named by the
    child; the foot of the perpendicular is clamped to the segment."""
    ends = ["c" + a for a in XYZ] + ["p" + a for a in XYZ]
    q = sites.select("*", *[F.col(a).alias(f"a{a}") for a in XYZ], *[F.lit(None).cast("double").alias(e) for e in ends])
    middle = [((F.col(a) + F.col(f"p{a}")) / 2).alias(f"a{a}") for a in XYZ]
    half = distance(XYZ, [f"p{a}" for a in XYZ]) / 2
    c = with_parent(tree).where("found").select(
        "neuron", "node_id", *middle, half.alias("rad"), *[F.col(a).alias(f"c{a}") for a in XYZ], *[f"p{a}" for a in XYZ]
    )

    def dist(a, b):
        return segment_distance([a[f"a{x}"] for x in XYZ], [b[f"c{x}"] for x in XYZ], [b[f"p{x}"] for x in XYZ])

    return nearest_within(q, c, ["neuron"], site_id, "node_id", dist, ends, numeric=(_segment_distance, ANCHORS, ends))


def nearest_contact(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: Sequence[str], b_id: str) -> DataFrame:
    """Per contact of ``a`` the contact of ``b`` with the same key and the least
    joint RMS distance of pre- and post-site (ties: least id).

    The anchor is the midpoint of the two sites: midpoints are never further
    apart than the joint RMS distance, as the search requires.
    """
    pre, post = [f"pre_{x}" for x in XYZ], [f"post_{x}" for x in XYZ]
    anchors = [((F.col(p) + F.col(q)) / 2).alias(f"a{x}") for x, p, q in zip(XYZ, pre, post)]
    queries = a.select("*", *anchors)
    candidates = b.select(*keys, b_id, *anchors, F.lit(0.0).alias("rad"), *pre, *post)

    def dist(q, c):
        return joint_rms(*[[s[x] for x in site] for s in (q, c) for site in (pre, post)])

    return nearest_within(queries, candidates, keys, a_id, b_id, dist, [*pre, *post], numeric=(_contact_distance, [*pre, *post], [*pre, *post]))
