"""Repeated byte strings against a dictionary of all strings of 200 bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tractum.llm import suffixes
from tractum.llm.queries import op1_suffix_dedup

L = 200


def check(rows, table):
    data = [(r.doc_id, (r.text or "").encode()) for r in table]
    seen = Counter(hashlib.blake2b(b[i:i + L], digest_size=12).digest() for _, b in data for i in range(len(b) - L + 1))
    want = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - L + 1):
            if seen[hashlib.blake2b(b[k:k + L], digest_size=12).digest()] > 1:
                gone[k:k + L] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=key)
    assert got == sorted(want, key=key)
    return sum(w[2] for w in want)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    assert check(op1_suffix_dedup(spark, folder).collect(), spark.read.parquet(f"{folder}/documents.parquet").collect()) > 0


@pytest.mark.parametrize("side_by_side", [2048, 2])
def test_edges(spark, tmp_path, monkeypatch, side_by_side):
    """Copies, passages at text borders, runs of one letter, exact lengths; crowded anchors settled string by string."""
    monkeypatch.setattr(suffixes, "SIDE_BY_SIDE", side_by_side)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdé fghi", k=n))
    passage, long = word(260), word(3000)
    texts = [None, "", "a" * 199, "b" * 200, "c" * 201, "ab" * 5000, "ab" * 300, long, long, long[:1500], long[1400:] + "x", word(199), word(5000)]
    texts += [word(rng.randrange(300)) + passage[rng.randrange(30):260 - rng.randrange(30)] + word(rng.randrange(300)) for _ in range(40)]
    exact = "".join(rng.choices("xyz", k=200))
    texts += [exact, exact, "q" + exact + "w", exact[:199] + "!"]
    rows = [(i, t, "clash", 3) for i, t in enumerate(texts)] + [(5, "ab" * 5000, "", 0), (None, long, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, n int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert check(op1_suffix_dedup(spark, str(tmp_path)).collect(), df.collect()) > 0
    assert suffixes.remove_repeats(df.limit(0), "doc_id", "text").count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeats(df, "doc_id", "text").collect() if r.doc_id in (2, 7, 11)}
    assert kept == {2: b"a" * 199, 7: b"", 11: texts[11].encode()}


def test_shuffled_ways(spark, monkeypatch):
    """Beyond the broadcast size the results are the same."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(suffixes, "BROADCAST_ROWS", 0)
    assert check(suffixes.remove_repeats(rows, "doc_id", "text").drop("kept").collect(), rows.collect()) > 0


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=80))
def test_suffix_array(text):
    data = text.encode()
    assert suffixes.suffix_array(data) == sorted(range(len(data)), key=lambda i: data[i:])
