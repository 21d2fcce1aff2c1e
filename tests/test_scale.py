"""Rows that joins and shuffles handle: work must grow with the input, not with products of its groups."""

from pyspark.sql import functions as F

from tractum.functions import columns
from tractum.operators import joins as J
from tractum.operators import reach as R
from tractum.operators import skeleton as S
from tractum.operators.nearest import nearest_within


def nodes(df):
    """The nodes of the final plan of ``df``, which is run for it."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            out.append((name, node))
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def joined_rows(df):
    return max(n.metrics().apply("numOutputRows").value() for name, n in nodes(df) if name.endswith("JoinExec"))


def test_an_id_asked_for_often_and_held_by_many(spark):
    requests = spark.range(2000).select(F.col("id").alias("request_id"), (F.col("id") % 2).alias("old_id"))
    walk = spark.range(1000).select((F.col("id") % 2).alias("old_id"), F.col("id").alias("new_id"), F.lit("a").alias("method"))
    out = J.resolution_candidates(requests, walk, ["a"])
    assert joined_rows(out) == 2000
    assert {tuple(r) for r in out.collect()} == {(i, "a", 1, i % 2, False) for i in range(2000)}


def test_sites_meet_their_nodes_within_a_row(spark):
    """No row per site and node is made or sorted, and a site is shuffled once."""
    sites = spark.range(40).selectExpr("id % 3 AS neuron", "id AS okey", "1 AS ln", "id * 1.5D AS x", "0D AS y", "0D AS z")
    tree = spark.range(60).selectExpr("id % 2 AS neuron", "id AS node_id", "id div 2 AS parent_id", "id * 2D AS x", "0D AS y", "0D AS z")
    for found in (S.nearest_node, S.nearest_segment):
        names = [name for name, _ in nodes(found(sites, tree, ["okey", "ln"]))]
        assert not {"GenerateExec", "SortAggregateExec"} & set(names) and names.count("ShuffleExchangeExec") <= 2


def test_batches_compare_like_columns(spark):
    """NULL and NaN coordinates, ties, keys without candidates, NULL keys and a key with many candidates."""
    odd = "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 7 = 0 THEN double('NaN') ELSE {} END"
    key = "CASE WHEN id % 5 < 4 THEN id % 5 END AS k"
    xyz = [f"{odd.format('id * 37 % 19D')} AS ax", "id * 13 % 5D AS ay", "0D AS az"]
    q = spark.range(200).selectExpr(key, "id AS q_id", *xyz)
    c = spark.range(120).selectExpr(key, "id AS c_id", *xyz, "0D AS rad").where("k IS NULL OR k <> 2")
    more = spark.range(150).selectExpr("1L AS k", "id + 500 AS c_id", "id * 1D AS ax", "id % 3D AS ay", "0D AS az", "0D AS rad")
    for candidates in (c, c.where("k IS NULL OR k <> 1").union(more)):
        def distance(a, b):
            return columns.distance([a[x] for x in S.ANCHORS], [b[x] for x in S.ANCHORS])
        plain, batched = [nearest_within(q, candidates, ["k"], ["q_id"], "c_id", distance, [], numeric=n).selectExpr("k", "q_id", "near_id", "string(near_dist) AS d").collect()
                          for n in (None, (S._node_distance, S.ANCHORS, S.ANCHORS))]
        assert sorted(map(str, plain)) == sorted(map(str, batched)) and len(plain) == 200


def test_reach_in_blocks_and_parts(spark, monkeypatch):
    """Three edges, one word of targets a part and few edges a block: the same as every path walked."""
    step = {i: {(i * 7 + j * j * 3) % 150 for j in range(1, 4)} - {i} for i in range(150)}
    monkeypatch.setattr(R, "LIST_BLOCK", 100)
    monkeypatch.setattr(R, "BITS_BLOCK", 1)
    edges = spark.createDataFrame([("a", i, j) for i, to in step.items() for j in to], "ver string, pre long, post long")
    sources, targets = [spark.createDataFrame([(i,) for i in ids], "id long") for ids in (range(0, 150, 5), range(0, 150))]
    got = {r.source: r.n for r in R.count_bits(R.reached(edges, sources, R.target_bits(targets), 3, ["ver"]), "n", ["ver"]).collect()}
    want = {s: {c for a in step[s] for b in step[a] - {s} for c in step[b] - {s, a}} for s in range(0, 150, 5)}
    assert got == {s: len(ends) for s, ends in want.items() if ends}


def test_paths_are_counted_as_they_are_joined(spark):
    """No aggregate by key takes a row of every exported path."""
    from tractum.catalog import load

    df = load()[0]["path_recheck"](spark, "/root/testdata/sf0.001")
    keyed = [n for name, n in nodes(df) if name.endswith("AggregateExec") and n.groupingExpressions().size()]
    assert df.first()["n_paths"] > 0 and not keyed
