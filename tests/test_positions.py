"""Positions, typed adjacency arrays, and each kind of fault counted."""

import random

import pytest
from pyspark.sql import functions as F

from tractum.operators import positions as P

ROWS = "pre long, post long, pre_index long, post_index long, n int, sign int, signed int"


def test_arrays_hold_the_graph(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10 ** 12), 60)
    edges = {(rng.choice(ids[:40]), rng.choice(ids)): rng.randrange(1, 9) for _ in range(500)}
    places = P.positions(spark.createDataFrame([(i,) for i in ids] + [(ids[0],), (None,)], "id long"))
    index = {r.id: r["index"] for r in places.collect()}
    assert index == {x: n for n, x in enumerate(sorted(ids))}
    e = P.indexed(spark.createDataFrame([(*k, n) for k, n in edges.items()], "pre long, post long, n int"), places)
    slotted = P.slots(e)
    nodes = {r.id: (r["index"], r.degree, r["first"]) for r in P.offsets(slotted, places).collect()}
    flat = {"pre": [], "post_index": [], "n": []}
    blocks = P.edge_arrays(slotted, ["post_index", "n"], block=64).orderBy("block").collect()
    for b in blocks:
        assert b["first"] == len(flat["pre"]) == 64 * b["block"]
        for c in flat:
            flat[c] += b[c]
    for i in ids:
        at, degree, first = nodes[i]
        run = slice(first, first + degree)
        assert flat["pre"][run] == [at] * degree
        assert list(zip(flat["post_index"][run], flat["n"][run])) == sorted((index[b], n) for (a, b), n in edges.items() if a == i)
    assert P.check_offsets(P.offsets(slotted, places), slotted).first().asDict() == {"n_edges": len(edges), "n_misplaced": 0, "n_nodes": 60, "n_slots": len(edges)}
    moved = slotted.withColumn("slot", F.when(F.col("slot") == 0, 10 ** 6).otherwise(F.col("slot")))
    assert P.check_offsets(P.offsets(slotted, places), moved).first()["n_misplaced"] == 1


@pytest.mark.parametrize("fault, counter", [
    ((10, 20, 2, 1, 3, -1, -3), "pre_mismatches"), ((10, 20, 0, 2, 3, -1, -3), "post_mismatches"), ((10, 20, 3, 1, 3, 1, 3), "pre_out_of_range"),
    ((10, 20, 0, -1, 3, 1, 3), "post_out_of_range"), ((10, 20, 0, None, 3, 1, 3), "post_out_of_range"), ((10, 20, 0, 1, 3, -1, 3), "sign_mismatches"),
    ((10, 20, 0, 1, 3, -1, None), "sign_mismatches"), ((None, 20, 0, 1, 3, 1, 3), "pre_mismatches")])
def test_each_fault_is_counted_once(spark, fault, counter):
    places = P.positions(spark.createDataFrame([(10,), (20,), (30,)], "id long"))
    good = [(10, 20, 0, 1, 3, 1, 3), (20, 30, 1, 2, 4, -1, -4)]
    got = P.check_positions(spark.createDataFrame([*good, fault], ROWS), places).first().asDict()
    kinds = [k for k in got if k.endswith(("mismatches", "out_of_range"))]
    assert {k: got[k] for k in kinds} == {k: int(k == counter) for k in kinds} and got["n_rows"] == 3


def test_empty(spark):
    places = P.positions(spark.createDataFrame([], "id long"))
    assert places.count() == 0
    assert P.check_positions(spark.createDataFrame([], ROWS), places).first()["n_rows"] == 0
