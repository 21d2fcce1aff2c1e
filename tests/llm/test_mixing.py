"""Targets and copies against a plain version."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tractum.llm import mixing
from tractum.llm.queries import op4_mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        w = sum(weight[s] for s in names if s not in stopped)
        target = {s: 3.0 * sizes[s] if s in stopped else left * weight[s] / w for s in names}
        above = {s for s in names if s not in stopped and target[s] > 3 * sizes[s]}
        if not above:
            return target
        stopped |= above


def check(rows, table):
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in table}
    per = defaultdict(int)
    for r in table:
        per[r.source] += size[r.doc_id]
    target = plain_targets(dict(per))
    source = {r.doc_id: r.source for r in table}
    assert len(rows) == len(table)
    for r in rows:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == per[s] and r.target == pytest.approx(target[s])
        rate = target[s] / per[s] if per[s] else 0
        assert r.taken in {int(rate) * r["size"], (int(rate) + 1) * r["size"], round(rate) * r["size"]} and r.taken <= 3 * r["size"]
    return per, target


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = op4_mixing(spark, folder).collect()
    check(rows, spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert sorted(rows) == sorted(op4_mixing(spark, folder).collect())


def test_edges(spark, tmp_path):
    rows = [(i, "w " * (i % 7), f"s{i % 4}") for i in range(400)] + [(1000, None, None), (1001, "a\tb\x0bc", None), (1002, None, "empty"), (1003, "x y", "é"), (1004, "x", "z"), (1005, "", "Z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    check(op4_mixing(spark, str(tmp_path)).collect(), df.collect())
    clash = df.withColumn("copies", F.lit("x")).withColumn("target", F.lit(1))
    mixed = mixing.mix(clash, "doc_id", "source", "text")
    assert mixed.columns == clash.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {
        r.doc_id: r._mix["copies"] for r in mixing.plan(df, "doc_id", "source", "text").collect() if r._mix["copies"]}
    assert mixing.plan(df.limit(0), "doc_id", "source", "text").count() == 0


def test_taken_comes_near_target(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 10).alias("text"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("string")).alias("source"))
    for r in mixing.plan(df, "doc_id", "source", "text").groupBy("source").agg(F.max("_mix.target").alias("t"), F.sum(F.col("_mix.copies") * F.col("_mix.size")).alias("n")).collect():
        assert abs(r.n - r.t) < 0.05 * r.t
