"""Components by one task and by rounds give the same."""

import random

import pytest

from tractum.llm import components as C


@pytest.mark.parametrize("edges_of_a_task", [1_000_000, 40])
def test_components(spark, monkeypatch, edges_of_a_task):
    monkeypatch.setattr(C, "EDGES", edges_of_a_task)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(80)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    rng.shuffle(edges)
    df = spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in edges], "a long, b long").repartition(6)
    got = {r.node: r.root for r in C.components(df).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_no_edges(spark):
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
