"""Degree-matched controls within exact strata.

Scores depend only on (in-degree, out-degree), so candidates are first reduced
to degree cells: a stratum holds few of them however many nodes it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractum.operators.nearest import nearest_within
from tractum.operators.ordered import rank_within
from tractum.session import stage


_ANYONE = 2**63 - 1  # a cell with room is open to every source


def _score(q: Column, c: Column) -> Column:
    gap_in = F.abs(F.log1p(q["in_degree"]) - F.log1p(c["in_degree"]))
    gap_out = F.abs(F.log1p(q["out_degree"]) - F.log1p(c["out_degree"]))
    return F.round(gap_in + gap_out, 9)


def _anchored(df: DataFrame) -> DataFrame:
    return df.select(
        "*", F.log1p("in_degree").alias("ax"), F.log1p("out_degree").alias("ay"), F.lit(0.0).alias("az"),
        F.lit(0.0).alias("rad"),
    )


def nearest_control(sources: DataFrame, candidates: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Per source the candidate of its stratum with the least difference of
    log degrees (ties: least id); candidates may serve several sources.

    Frames: id, in_degree, out_degree, strata.  The sum of two absolute
    differences is at least the Euclidean distance, as the search requires.
    """
    q = _anchored(sources.withColumnRenamed("id", "source"))
    c = _anchored(candidates)
    found = nearest_within(q, c, strata, ["source"], "id", _score, ["in_degree", "out_degree"])
    return found.select("source", F.col("near_id").alias("control"), F.col("near_dist").alias("score"), *strata)


def greedy_match(sources: DataFrame, candidates: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Controls without reuse: sources choose in id order, each the nearest
    candidate that no earlier source took (ties: the degree cell with the
    least id, then the least id in it).

    Choosing one after the other gives the stable matching in which every
    candidate prefers the earliest source, so it is found in parallel rounds:
    each unplaced source proposes to its best cell that has room or holds a
    later source, and a cell of m candidates keeps its m earliest sources.
    Rounds go on until nothing changes; a cell's holders only ever become
    earlier, so they end.  A source that finds no candidate has a NULL control.
    """
    strata = list(strata)
    cell = [*strata, "cid"]
    shape = [*strata, "in_degree", "out_degree"]
    members = candidates.select("id", *shape)
    cells = stage(members.groupBy(*shape).agg(F.min("id").alias("cid"), F.count("*").alias("room")))
    unplaced = stage(sources.select(F.col("id").alias("source"), *shape))
    everyone, placed = unplaced, None
    while True:
        open_to = F.lit(_ANYONE)
        offered = cells
        if placed is not None:
            taken = placed.groupBy(*cell).agg(F.count("*").alias("_held"), F.max("source").alias("_last"))
            offered = cells.join(taken, cell, "left")
            open_to = F.when(F.col("_held") >= F.col("room"), F.col("_last")).otherwise(F.lit(_ANYONE))
        offered = _anchored(offered.select(*shape, "cid", open_to.alias("open_to"))).withColumnRenamed("cid", "cell_id")
        offered = offered.withColumn("order", F.lit(None).cast("long"))
        q = _anchored(unplaced.select("*", F.lit(0).cast("long").alias("open_to"), F.col("source").alias("order")))
        found = nearest_within(
            q, offered, strata, ["source"], "cell_id", _score, ["in_degree", "out_degree", "open_to", "order"],
            eligible=lambda q, c: c["open_to"] > q["order"], most_open="open_to",
        )
        proposals = stage(found.where("near_id IS NOT NULL").select(*strata, "source", F.col("near_id").alias("cid")))
        if proposals.isEmpty():
            break
        pool = proposals if placed is None else placed.select(proposals.columns).union(proposals)
        ranked = rank_within(pool, cell, ["source"], "_r").join(cells.select(*cell, "room"), cell)
        placed = stage(ranked.where("_r <= room").select(*strata, "source", "cid"))
        unplaced = stage(everyone.join(placed, [*strata, "source"], "left_anti"))
        if unplaced.isEmpty():
            break
    if placed is None:
        return everyone.select(*strata, "source", F.lit(None).cast(members.schema["id"].dataType).alias("control"))
    numbered = rank_within(members.join(cells, shape), cell, ["id"], "_r").select(*cell, "_r", F.col("id").alias("control"))
    matched = rank_within(placed, cell, ["source"], "_r").join(numbered, [*cell, "_r"]).select("source", "control")
    return everyone.select(*strata, "source").join(matched, "source", "left").select(*strata, "source", "control")


def nearest_free(wanted: DataFrame, pool: DataFrame, taken: DataFrame, key: str, stratum: str, measure: str) -> DataFrame:
    """``key`` and ``id``: of the pool's nodes in the stratum the one nearest in
    ``measure`` (ties: least id) that the key has not taken; keys without one
    are left out.

    ``wanted``: key, stratum, measure; ``pool``: id, stratum, measure; ``taken``:
    key, id.  Distances are judged on the distinct measures of a stratum.  In the
    nearest cells with a free node its first ``taken + 1`` ids must hold one, so
    no key meets a whole cell.
    """
    place = [stratum, measure]
    pool = pool.select("id", *place)
    cells = pool.groupBy(*place).agg(F.count("*").alias("_size"))
    used = taken.join(pool, "id").groupBy(key, *place).agg(F.count("*").alias("_used"))
    options = wanted.select(key, stratum, F.col(measure).alias("_wanted")).join(cells, stratum).join(used, [key, *place], "left").fillna(0, ["_used"])
    options = options.where("_size > _used").withColumn("_gap", F.abs(F.col(measure) - F.col("_wanted")))
    nearest = options.groupBy(key).agg(F.min("_gap").alias("_gap"))
    asked = options.join(nearest, [key, "_gap"]).select(key, *place, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_used") + 1)).alias("_r"))
    free = asked.join(rank_within(pool, place, ["id"], "_r"), [*place, "_r"]).select(key, "id").join(taken, [key, "id"], "left_anti")
    return free.groupBy(key).agg(F.min("id").alias("id"))
