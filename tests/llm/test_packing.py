"""Packing: every token placed once, bins hold their contents, little waste."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tractum.llm import packing
from tractum.llm.queries import op8_packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60))
def test_best_fit_holds_every_piece(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets, caps = packing.best_fit(lengths, (8, 16, 32, 64), 4)
    used = {}
    for b, o, n in zip(bins, offsets, lengths):
        used.setdefault(int(b), []).append((int(o), int(n)))
    assert sorted(used) == list(range(len(caps)))
    for b, parts in used.items():
        at = 0
        for o, n in sorted(p for p in parts if p[1]):
            assert o == at
            at += n
        assert at <= caps[b] and not any(at <= c < caps[b] for c in (8, 16, 32, 64))


def test_longest_first_into_the_fullest_bin():
    bins, offsets, caps = packing.best_fit(np.array([10, 54, 20, 44, 1]), (64,), 0)
    assert bins.tolist() == [0, 0, 1, 1, 2] and caps.tolist() == [64, 64, 64]
    # A lone short piece opens the shortest bin; a bin with room is cut down in the end.
    assert packing.best_fit(np.array([5]), (8, 64), 4)[2].tolist() == [8]
    assert packing.best_fit(np.array([50, 3]), (8, 64), 4)[2].tolist() == [64]


def check(rows, lengths, capacities):
    docs, bins = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        bins.setdefault(r.bin_id, []).append(r)
    for i, n in lengths.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(docs[i])):
            assert (piece, start) == (k, at)
            at += length
        assert at == n
    assert set(docs) == set(lengths)
    for parts in bins.values():
        filled = sum(p.length for p in parts)
        at = 0
        for p in sorted((p for p in parts if p.length), key=lambda p: p.offset):
            assert p.offset == at and p.filled == filled and p.capacity == min(c for c in capacities if c >= filled)
            at += p.length
    return sum(parts[0].capacity for parts in bins.values())


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    lengths = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1 for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    padded = check(op8_packing(spark, folder).collect(), lengths, packing.CAPACITIES)
    assert padded < 1.01 * sum(lengths.values()) + max(packing.CAPACITIES)


@pytest.mark.parametrize("group", [50_000, 7])
def test_edges(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    lengths = {1: 0, 2: 100_000, 3: 8192, 4: 8193, 5: 1, **{i: i % 900 for i in range(10, 200)}}
    df = spark.createDataFrame([(i, n, 5, "x") for i, n in lengths.items()], "doc_id long, n long, bin_id int, length string")
    check(packing.pack(df, "doc_id", F.col("n")).collect(), lengths, packing.CAPACITIES)
    many = spark.createDataFrame([(None, None), (7, 3), (7, 3), (None, 4)], "doc_id long, n long")
    assert sorted(((r.doc_id or -1), r.length) for r in packing.pack(many, "doc_id", F.col("n")).collect()) == [(-1, 0), (-1, 4), (7, 3), (7, 3)]
    assert packing.pack(many.limit(0), "doc_id", F.col("n")).count() == 0
