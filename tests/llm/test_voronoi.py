"""Exact search against plain inner products."""

import math
import random

import pytest

from check import compare, connect
from tractum.llm import voronoi
from tractum.llm.queries import ORACLES, op5_topk


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_against_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    problem, n = compare(spark, connect(folder), "op5_topk", op5_topk, ORACLES["op5_topk"], folder)
    assert not problem and n


def plain(rows, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i is None or i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0, j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q)]
        out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["mixed", "clustered", "tiny"])
def test_edges(spark, tmp_path, case, monkeypatch):
    rng = random.Random(2)
    if case == "mixed":
        rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(700)] + [(i, [0.5] * 8) for i in range(700, 1100)]
        rows += [(1200, None), (1300, [1.0, None]), (1400, [float("nan")] * 8), (1500, [float("inf")] * 8), (1600, []), (1700, []), (1800, [1.0]), (None, [0.25] * 8), (100, [0.5] * 8), (100, [0.5] * 8), (1900, [3e6] * 2), (2000, [3e6 + 1, -2e6]), (1901, [3e3] * 2)]
    elif case == "clustered":
        monkeypatch.setattr(voronoi, "MOST_BLOCK", 64)
        centres = [[rng.gauss(0, 10) for _ in range(6)] for _ in range(12)]
        rows = [(i, [c + rng.gauss(0, 0.1) for c in centres[0 if i % 3 == 0 else i % 12]]) for i in range(1500)]
    else:
        rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (7, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, cell string")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op5_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    assert op5_topk(spark, str(tmp_path)).count() == len(got)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert voronoi.search(df, "vec_id", "embedding", voronoi.F.col("id") % 100 == 0).count() == 0
