"""Connected components over an edge table, without collecting it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractum.session import stage

EDGES = 1_000_000  # edges that a task reduces to a forest before the rounds


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of the links a-b.

    Keeps what the links connect in at most one row per node.
    """
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a partition's edges with the least node of its component there."""
    got = [f for f in frames if f.num_rows]
    if got:
        node, root = local_roots(*(np.concatenate([f.column(k).to_numpy() for f in got]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges ``(a, b)`` but the roots; root is the least
    node reachable.  Edges are first dealt to tasks, ``EDGES`` to each, which
    reduce them to a forest; where one task has seen all edges that is the
    result.  Otherwise alternating large-star and small-star rounds follow: each is a
    map-side combined minimum and a join, so a hub is never gathered.  Rounds
    are staged in the shared folder, which cuts the lineage.

    Building the result runs jobs.  An empty table gives an empty result.
    """
    def star(e: DataFrame, both: bool) -> DataFrame:
        high = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        near = high.union(high.select("v", "u")) if both else high
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = near.join(least, "u")
        if both:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first())

    current = stage(edges.select("a", "b").where("a <> b"))
    tasks = max(1, -(-current.count() // EDGES))
    current = stage(current.coalesce(tasks).mapInArrow(_forest, "a long, b long"))
    if tasks == 1:
        return current.toDF("node", "root")
    current = stage(current.distinct())
    before = mark(current)
    while True:
        current = stage(star(star(current, True), False))
        after = mark(current)
        if after == before:
            break
        before = after
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
