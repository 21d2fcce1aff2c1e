"""Merkle manifest against a plain tree; ragged runs, several butterfly rounds, tampering."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tractum.llm import merkle
from tractum.llm.queries import op12_merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row):
    return sha("".join(encoded(row[f]) for f in FIELDS))


def climb(nodes, fanout=8):
    """Root and, for each leaf, its list of (place, run)."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, x in enumerate(at):
            first = x // fanout * fanout
            paths[i].append((x - first, nodes[first:first + fanout]))
        at = [x // fanout for x in at]
        nodes = [sha("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain(rows, fanout=8):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[g] = climb([leaf_of(r) for r in groups[g]], fanout)
    root, over = climb([trees[g][0] for g in order], fanout)
    out = []
    for g, up in zip(order, over):
        sub, paths = trees[g]
        for r, path in zip(groups[g], paths):
            now = leaf_of(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                now = leaf_of({**r, "text": lower})
            proof = ""
            for at, run in path + up:
                proof += "".join(run[:at] + run[at + 1:])
                now = sha("".join(run[:at] + [now] + run[at + 1:]))
            out.append((r["doc_id"], leaf_of(r), sub, root, sha(proof), now, now == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = plain(rows)
    assert got(op12_merkle(spark, folder)) == want
    assert {True, False} == {w[-1] for w in want}


def test_nulls_empty_long_repeated_and_clashing(spark, tmp_path):
    rows = [(1, "A", None, None, 3, 9), (1, "A", None, None, 3, 9), (None, None, None, "s", None, 9), (2, "", "", "", 0, 9), (3, "É" * 50_000, "é", "ß", 1, 9),
            (4, "Lone", "zz", "s", 4, 9), (-5, "B", "", "s", 1, 9), (6, None, "", None, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _block int")
    df.withColumn("digest", F.lit("x")).withColumn("_place", F.lit(0)).write.parquet(str(tmp_path / "documents.parquet"))
    assert got(op12_merkle(spark, str(tmp_path))) == plain([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows])


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 27, 28, 55, 82, 244])
def test_butterfly_rounds(spark, n):
    """Fanout 3 and blocks of 3 leaves: up to four rounds, ragged at every level."""
    rows = [{"doc_id": i, "source": "s", "lang": "a" if i else "b", "n_chars": i, "text": f"T{i}"} for i in range(n)]
    leaves = [(r["doc_id"], r["lang"], leaf_of(r), leaf_of({**r, "text": r["text"].lower()}) if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 else leaf_of(r)) for r in rows]
    df = spark.createDataFrame(leaves, "doc_id long, lang string, leaf string, claimed string").withColumn("digest", F.col("leaf"))
    assert got(merkle.prove(df, ["doc_id"], "lang", ["doc_id", "leaf"], "claimed", fanout=3, depth=1)) == plain(rows, 3)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, digest string, leaf string, claimed string")
    assert merkle.prove(df, ["doc_id"], "lang", ["doc_id", "leaf"], "claimed").count() == 0
