"""MinHash groups against a plain version over all pairs."""

import random
import re

import numpy as np
import pytest

from tractum.llm import forest
from tractum.llm.queries import op11_minhash


def shingles(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[j:j + width]) for j in range(max(1, len(words) - width + 1))) if words else frozenset()


def plain(rows, percent=85):
    """(id, n_shingles, component) from all pairs."""
    sets = {}
    for i, text in rows:
        sets.setdefault(shingles(text), []).append(i)
    keys = [k for k in sets if k]
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k in keys:
        for s in k:
            holders.setdefault(s, []).append(k)
    for k in keys:
        shared = {}
        for s in k:
            for other in holders[s]:
                shared[other] = shared.get(other, 0) + 1
        for other, n in shared.items():
            if other is not k and 100 * n >= percent * (len(k) + len(other) - n):
                root[find(k)] = find(other)
    least = {}
    for k in keys:
        ids = [i for i in sets[k] if i is not None] + ([least[find(k)]] if least.get(find(k)) is not None else [])
        least[find(k)] = min(ids, default=None)
    return sorted(((i, len(k), least[find(k)] if k else i) for k, ids in sets.items() for i in ids), key=str)


def got(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = plain(rows)
    assert got(op11_minhash(spark, folder)) == want
    assert any(c != i for i, _, c in want)


def test_nulls_ties_short_and_long_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "One two"), (5, "one  two"), (6, "x " * 60_000), (None, "X x x x"), (7, "one two three"), (7, "one two three"),
            (None, None), (None, "alone in here and without any name"), (8, "é ß 漢 " * 10)]
    df = spark.createDataFrame([(i, t, 0, "k", 1) for i, t in rows], "doc_id long, text string, size int, key string, node int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows_got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op11_minhash(spark, str(tmp_path)).collect()), key=str)
    assert [r[:3] for r in rows_got] == plain(rows)
    assert {r[3] for r in rows_got if r[0] is None and r[1] != 1} == {True} and (None, 1, 6, False) in rows_got


@pytest.mark.parametrize("region, strays, cell, ranges", [(32, 512, 2048, 8), (8, 60, 16, 1), (8, 60, 40, 30)])
def test_crowds(spark, monkeypatch, region, strays, cell, ranges):
    """A large group of near copies with strays that one member alone links, a star whose
    members are alike only with its middle, and many texts round one common passage."""
    monkeypatch.setattr(forest, "STRAYS", strays)
    monkeypatch.setattr(forest, "CELL", cell)
    monkeypatch.setattr(forest, "HUB", 5)
    rng = random.Random(7)
    texts = {}

    def edited(words, n, tag):
        words = list(words)
        for k in range(n):
            words[rng.randrange(len(words))] = f"{tag}_{k}"
        return words

    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    for i in range(150):
        texts[1000 + i] = edited(base, 2, f"c{i}")
    for i in range(15):  # each linked through one of the copies
        texts[i] = edited(texts[1000 + 10 * i], 4, f"s{i}")
    middle = [f"m{rng.randrange(5000)}" for _ in range(200)]
    texts[2000] = middle
    for i in range(120):
        words = list(middle)
        for k in range(5):
            words[20 + 36 * k + rng.randrange(25)] = f"t{i}_{k}"
        texts[2001 + i] = words
    passage = [f"p{rng.randrange(5000)}" for _ in range(120)]
    for i in range(200):
        own = [f"q{rng.randrange(10 ** 6)}" for _ in range(60)]
        texts[3000 + 2 * i] = own[:30] + passage + own[30:]
        texts[3001 + 2 * i] = edited(texts[3000 + 2 * i], 1 + i % 6, f"e{i}")
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        have = got(forest.near_duplicates(df, "doc_id", "text", forest.Forest(region=region)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert have == plain(rows)


def test_parts_follow_the_depth():
    """A region of three levels goes deeper where it is crowded; equal labels are cut in runs."""
    scheme = forest.Forest(levels=6, region=3)
    labels = np.array([[1, 1, 1, 1, 1, 1]] * 7 + [[1, 1, 1, 2, 0, 0], [1, 1, 1, 2, 0, 1], [1, 1, 2, 0, 0, 0], [1, 1, 2, 0, 0, 1]])
    stop, whole = forest._parts(forest._shared_levels(np.zeros(11, int), labels), scheme)
    assert stop.tolist() == [3, 3, 3, 6, 6, 6, 7, 9, 9, 11, 11]
    assert whole.tolist() == [False] * 9 + [True] * 2


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 1100, np.uint64)
    both = np.concatenate((h[:1000], h[100:]))
    sig = forest.minima(both, np.array([0, 1000, 2000]), forest.Forest(trees=50, levels=20))
    assert abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.05


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert forest.near_duplicates(df, "doc_id", "text").count() == 0
