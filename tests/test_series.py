"""Peaks and autocorrelation against plain versions; one series over many partitions."""

import random

import pytest

from tractum.operators import series


def plain_peaks(v):
    runs, i = [], 0
    while i < len(v):
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        runs.append((i, j))
        i = j + 1
    out = []
    for a, b in runs[1:-1]:
        if v[a - 1] < v[a] > v[b + 1]:
            sides = []
            for step, at in ((-1, a), (1, b)):
                low = v[a]
                while 0 <= at < len(v) and v[at] <= v[a]:
                    low = min(low, v[at])
                    at += step
                sides.append(low)
            out.append(((a + b) // 2, v[a], v[a] - max(sides)))
    return out


SHAPES = {
    "random": lambda rng, n: [float(rng.randrange(30)) for _ in range(n)],
    "rough": lambda rng, n: [rng.random() for _ in range(n)],
    "rising": lambda rng, n: [i + 3.0 * (i % 2) for i in range(n)],
    "falling": lambda rng, n: [-i + 3.0 * (i % 2) for i in range(n)],
    "valley": lambda rng, n: [abs(i - n / 2) + 2.0 * (i % 2) for i in range(n)],
    "plateaus": lambda rng, n: [float(i // 97 % 2) for i in range(n)],
    "one top": lambda rng, n: [1000.0 if i == n // 3 else float(i % 3) for i in range(n)],
    "flat": lambda rng, n: [1.0] * n,
}


@pytest.fixture(params=[1, 3, 40])
def parts(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_peaks(spark, parts):
    """A hot series of each shape, short series, a NULL key, values that are left out."""
    rng = random.Random(parts)
    keyed = {name: make(rng, 700) for name, make in SHAPES.items()}
    keyed |= {None: [1.0, 3.0, 2.0, 5.0, 1.0], "one": [1.0], "two": [1.0, 2.0], "three": [1.0, 2.0, 1.0]}
    rows = [(k, t, v) for k, vs in keyed.items() for t, v in enumerate(vs)] + [("three", 9, None), ("three", 10, float("nan")), ("no values", 1, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, r[1] * 10, 0) for r in rows], "key string, t int, x double, at int, i int")
    got = {}
    for r in series.peaks(df, "key", ["t"], "x", ["at"]).collect():
        assert r["at"] == 10 * r.i
        got.setdefault(r.key, []).append((r.i, r.x, pytest.approx(r.prominence)))
    want = {k: plain_peaks(vs) for k, vs in keyed.items()}
    assert {k: sorted(v, key=lambda p: p[0]) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_autocorrelation(spark, parts):
    rng = random.Random(1)
    keyed = {"hot": [rng.random() for _ in range(500)], None: [1.0, 2.0, 4.0, 8.0], "flat": [2.0] * 5, "one": [3.0], "wave": [float(i % 6 < 3) for i in range(300)]}
    df = spark.createDataFrame([(k, t, v) for k, vs in keyed.items() for t, v in enumerate(vs)] + [("flat", 7, None)], "k string, t int, v double")
    lags = [1, 3, 6, 40]
    out = series.autocorrelation(df, "k", [df.t], "v", lags, block=50)
    got = {(r.k, r.lag): (r.n, r.r) for r in out.collect()}
    want = {}
    for k, v in keyed.items():
        m = sum(v) / len(v)
        x = [a - m for a in v]
        total = sum(a * a for a in x)
        for lag in lags:
            if lag < len(v):
                want[k, lag] = (len(v), pytest.approx(sum(a * b for a, b in zip(x, x[lag:])) / total if total else 0.0))
    assert got == want
    best = {r.k: (r.lag, r.frequency) for r in series.rhythm(out, "k", 0.5).collect()}
    assert best["wave"] == (6, pytest.approx(1 / 3)) and best["flat"][0] == 1


def test_empty(spark):
    df = spark.createDataFrame([], "k long, t int, v double")
    assert series.peaks(df, "k", ["t"], "v").count() == 0
    assert series.autocorrelation(df, "k", ["t"], "v", [1, 2]).count() == 0
