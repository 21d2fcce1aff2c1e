"""Dense positions of ids and typed adjacency arrays (offsets, targets, weights).

Positions and slots are ranks over range partitions, so no task numbers a whole
table; arrays come in blocks of a fixed number of slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractum.operators.ordered import Ordered, rank_within
from tractum.session import stage


def positions(ids: DataFrame, id_column: str = "id") -> DataFrame:
    """``index`` (from 0, in order of the id) of each distinct id; NULL has none."""
    known = ids.select(F.col(id_column).alias("id")).where("id is not null").distinct()
    return stage(rank_within(known, [], ["id"], "index").select((F.col("index") - 1).alias("index"), "id"))


def indexed(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Adds ``pre_index`` and ``post_index``, NULL for ids without a position."""
    out = edges
    for end in ("pre", "post"):
        out = out.join(places.select(F.col("id").alias(end), F.col("index").alias(f"{end}_index")), end, "left")
    return out


def offsets(edges: DataFrame, places: DataFrame) -> DataFrame:
    """``index``, ``id``, ``degree`` and ``first``, the slot at which the node's
    edges begin; a node without edges has an empty run of slots."""
    degree = edges.groupBy("pre_index").agg(F.count("*").alias("degree"))
    nodes = places.join(degree, places["index"] == degree["pre_index"], "left").select("index", "id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    return Ordered(nodes, [], ["index"]).running_sum("degree", "_upto").select("index", "id", "degree", (F.col("_upto") - F.col("degree")).alias("first"))


def slots(edges: DataFrame) -> DataFrame:
    """Adds ``slot``: edges in order of (pre_index, post_index), from 0."""
    return rank_within(edges, [], ["pre_index", "post_index"], "slot").withColumn("slot", F.col("slot") - 1)


def edge_arrays(slotted: DataFrame, columns: Sequence[str], block: int = 65536) -> DataFrame:
    """``block``, ``first`` (slot), ``pre`` and one array for each of
    ``columns`` (of its own type), all of the same length: slots
    ``first .. first + length - 1``.  ``pre`` is the source of each slot."""
    item = F.struct("slot", F.col("pre_index").alias("pre"), *columns)
    grouped = slotted.groupBy(F.floor(F.col("slot") / block).alias("block")).agg(F.min("slot").alias("first"), F.sort_array(F.collect_list(item)).alias("_items"))
    return grouped.select("block", "first", *[F.col("_items")[c].alias(c) for c in ("pre", *columns)])


def check_positions(rows: DataFrame, places: DataFrame) -> DataFrame:
    """One row of counts over edges that carry ids and positions: pre, post,
    pre_index, post_index, n, sign, signed.

    An index outside ``0 .. nodes - 1`` (or NULL) is out of range and not
    looked up; an index that names another id is a mismatch; ``signed`` must be
    sign times n."""
    nodes = places.agg(F.count("*")).scalar()
    marked = rows
    for end in ("pre", "post"):
        found = places.select(F.col("index").alias(f"{end}_index"), F.col("id").alias(f"_{end}_id"))
        marked = marked.join(found, f"{end}_index", "left")

    def outside(end: str) -> Column:
        index = F.col(f"{end}_index")
        return index.isNull() | (index < 0) | (index >= nodes)

    return marked.agg(
        F.count("*").alias("n_rows"), F.sum("n").alias("weight"),
        *[F.count_if(outside(e)).alias(f"{e}_out_of_range") for e in ("pre", "post")],
        *[F.count_if(~outside(e) & ~F.col(f"_{e}_id").eqNullSafe(F.col(e))).alias(f"{e}_mismatches") for e in ("pre", "post")],
        F.count_if(~(F.col("sign") * F.col("n")).eqNullSafe(F.col("signed"))).alias("sign_mismatches"),
        F.count_if(F.col("sign") > 0).alias("n_positive"), F.count_if(F.col("sign") < 0).alias("n_negative"))


def check_offsets(nodes: DataFrame, slotted: DataFrame) -> DataFrame:
    """One row: nodes, edges, and the slots that lie outside the run of their source."""
    run = nodes.select(F.col("index").alias("pre_index"), "first", "degree")
    inside = (F.col("slot") >= F.col("first")) & (F.col("slot") < F.col("first") + F.col("degree"))
    misplaced = slotted.join(run, "pre_index", "left").agg(F.count("*").alias("n_edges"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("n_misplaced"))
    return misplaced.withColumns({"n_nodes": nodes.agg(F.count("*")).scalar(), "n_slots": nodes.agg(F.sum("degree")).scalar()})
