"""Aggregates by key whose tasks grow in number, not in size, with the rows."""

import pytest
from pyspark.sql import functions as F

from check import compare, connect
from tractum.catalog import load
from tractum.operators import graph as G
from tractum.operators import tasks as T

FOLDER = "/root/testdata/sf0.001"


def rows(spark, n):
    """A third of the rows has one key; some keys are NULL."""
    return spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 <> 1 THEN id END AS pre", "id % 2 AS post", "id AS v")


@pytest.mark.parametrize("n", [1000, 4000])
def test_tasks_hold_so_many_rows(spark, monkeypatch, n):
    monkeypatch.setattr(T, "ROWS_PER_TASK", 100)
    df, keys = rows(spark, n), ["pre", "post"]
    size = T.sizing(df, keys)
    assert size.tasks == n // 100 and 1 <= len(size.heavy) <= 3
    out = T.grouped(df, keys, keys, [F.count("*").alias("n"), F.sum("v").alias("v")])
    assert sorted(map(str, out.collect())) == sorted(map(str, df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect()))
    light = df.where("pre IS NOT NULL AND pre <> 7")
    out = T.grouped(light, keys, keys, [F.count("*").alias("n")])
    assert max(out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()) < 200


def test_the_graph_is_built_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS_PER_TASK", 100)
    edges = spark.range(4000).selectExpr("id AS pre", "id % 7 AS post", "1 AS n", "0.5D AS p")
    out = G.build_graph(edges, spark.range(4000), ["p"])
    assert out.count() == 4000 and out.select(F.spark_partition_id()).distinct().count() > 30


@pytest.mark.parametrize("key", ["graph_build", "partner_type_rollup", "partner_patterns", "point_key_recon", "filter_rule_search", "pair_agg", "edge_delta_region"])
def test_queries_in_many_tasks(spark, monkeypatch, key):
    monkeypatch.setattr(T, "ROWS_PER_TASK", 500)
    queries, oracles = load()
    problem, n = compare(spark, connect(FOLDER), key, queries[key], oracles[key], FOLDER)
    assert not problem and n


def test_lists_are_numbered_in_one_shuffle(spark, monkeypatch):
    """Keys that fit a task are not laid out by range; a key that does not is, and gives the same chunks."""
    from tractum.operators import aggs as A

    calls, plain = [], A.rank_within
    monkeypatch.setattr(A, "rank_within", lambda *a: calls.append(a) or plain(*a))
    df, got = rows(spark, 1000), []
    for limit in (500_000, 100):
        monkeypatch.setattr(T, "ROWS_PER_TASK", limit)
        got.append(sorted(map(str, A.chunked_list(df, ["pre", "post"], ["v"], F.col("v"), "vs", 7).collect())))
    assert got[0] == got[1] and len(calls) == 1


@pytest.mark.parametrize("key", ["evidence_rollup", "pair_candidates", "adjacency"])
def test_lists_in_many_tasks(spark, monkeypatch, key):
    monkeypatch.setattr(T, "ROWS_PER_TASK", 500)
    queries, oracles = load()
    problem, n = compare(spark, connect(FOLDER), key, queries[key], oracles[key], FOLDER)
    assert not problem and n
