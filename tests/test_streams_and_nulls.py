"""Streams in several micro-batches, NULL keys, and values that are not finite."""

import pytest
from pyspark.sql import functions as F

from check import canonical
from tractum.catalog import load, streams
from tractum.functions import columns as C
from tractum.operators import aggs, graph, joins, ordered, sets
from tractum.streaming import operators as S
from tractum.streaming.runner import latest, read_events

STREAMS = ["stream_edge_counts", "stream_dedup", "stream_sliding_rate", "stream_latest_fresh", "stream_ewma", "stream_validate", "stream_tumbling", "observe_metrics"]


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """The events in four files, newest first."""
    folder = tmp_path_factory.mktemp("events")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    cuts = [None, *[r.t for r in events.select(F.expr("percentile_approx(unix_micros(ts::timestamp), array(0.25, 0.5, 0.75))").alias("c")).select(F.explode("c").alias("t")).collect()], None]
    for i in range(4):
        t = F.expr("unix_micros(ts::timestamp)")
        part = events.where((t > cuts[i]) if cuts[i] else F.lit(True)).where((t <= cuts[i + 1]) if cuts[i + 1] else F.lit(True))
        part.coalesce(1).write.parquet(str(folder / "tmp" / str(i)))
    (folder / "events.parquet").mkdir()
    for order, i in enumerate((3, 2, 1, 0)):
        source = next((folder / "tmp" / str(i)).glob("part-*.parquet"))
        (folder / "events.parquet" / f"{order}.parquet").write_bytes(source.read_bytes())
    return str(folder)


@pytest.mark.parametrize("key", STREAMS)
def test_results_do_not_depend_on_batches(spark, split_events, monkeypatch, key):
    one = load()[0][key](spark, "/root/testdata/sf0.001")
    want = canonical(one.collect(), one.columns)
    monkeypatch.setattr(streams, "FILES", 1)
    got = load()[0][key](spark, split_events)
    assert canonical(got.collect(), got.columns) == want


def test_recurrence_refuses_disorder(spark, split_events):
    stream = S.with_event_time(read_events(spark, split_events, 1), F.expr("unix_millis(ts::timestamp)"))
    with pytest.raises(Exception, match="go back in time"):
        latest(S.ewma(stream.select(F.col("user_id").alias("id"), "t_ms", "event_id", "value"), 0.2), ["id"]).collect()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 2), (None, 2)], "k string, v int")
    assert rows(aggs.share_of_total(df, ["k"], "v", "t", "s")) == [("a", 1, 4, 0.25), ("a", 3, 4, 0.75), (None, 2, 4, 0.5), (None, 2, 4, 0.5)]
    assert rows(aggs.group_size(df, ["k"], "n")) == [("a", 1, 2), ("a", 3, 2), (None, 2, 2), (None, 2, 2)]
    assert sets.stratified_sample(df, "k", "v", 2, 8).count() == 4
    more = spark.createDataFrame([("a", 5), ("a", None), (None, 4), (None, None), (None, 7)], "k string, n int")
    assert rows(ordered.upper_median(more, ["k"], "n").toDF("k", "total", "m")) == [("a", 1, 5), (None, 2, 7)]
    stats = ordered.order_statistics(more, ["k"], "n", {"p50": 0.5})
    assert rows(stats.select("k", "p50")) == [("a", 5.0), (None, 5.5)]


def test_null_regions_are_one_key(spark):
    a = spark.createDataFrame([(1, 2, None, 3), (1, 2, "x", 1)], "pre long, post long, region string, n long")
    b = spark.createDataFrame([(1, 2, None, 3), (1, 3, None, 2)], "pre long, post long, region string, n long")
    keys = ["pre", "post", "region"]
    got = {(r.post, r.region): (r.n_a, r.n_b, r.delta) for r in joins.version_delta(a, b, keys).collect()}
    assert got == {(2, None): (3, 3, 0), (2, "x"): (1, None, -1), (3, None): (None, 2, 2)}
    assert rows(joins.reconcile(a, b, keys)) == [(1, 2, "x", 1, 0, "raw_only"), (1, 3, None, 0, 2, "published_only")]
    assert {(r.post, r.region): r.in_both for r in joins.key_union(a, b, keys).collect()} == {(2, None): True, (2, "x"): False, (3, None): False}


def test_only_finite_values_are_clipped(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,), (-0.5,), (0.25,), (None,)], "p double")
    assert [r[0] for r in df.select(C.clip_probability("p")).collect()] == [0.0, 0.0, 0.0, 1.0, 0.0, 0.25, None]
    edges = spark.createDataFrame([(1, 2, "r", 2, float("nan")), (1, 2, "s", 2, 0.5)], "pre long, post long, region string, n long, p double")
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    assert graph.build_graph(edges, nodes, ["p"]).first()["p"] == 0.25
