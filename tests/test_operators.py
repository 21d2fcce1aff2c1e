"""Operators on small literal frames, against brute force where order matters."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tractum.functions import columns as C
from tractum.functions.udfs import fnv1a_udf
from tractum.operators import aggs as A
from tractum.operators import graph as G
from tractum.operators import joins as J
from tractum.operators import nearest
from tractum.operators.matching import greedy_match
from tractum.operators.ordered import Ordered, lag_within, order_statistics, rank_within, top_k, trailing_sum, upper_median, weighted_decay
from tractum.operators.skeleton import nearest_contact, nearest_node, nearest_segment, topology
from tractum.plans.checks import ledger, require_passed
from tractum.plans.reconcile import explain_residual
from tractum.plans.registry import scrub_text


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds a third of the rows; values repeat."""
    rng = random.Random(5)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(50), i) for i in range(3000)]
    return data, spark.createDataFrame(data, "k string, v int, i int").repartition(7)


def by_key(data):
    groups = {}
    for k, v, i in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(k, []).append((v, i))
    return groups


def test_rank_of_hot_key(hot):
    data, df = hot
    want = {(k, v, i): n for k, g in by_key(data).items() for n, (v, i) in enumerate(g, 1)}
    assert {r[:3]: r[3] for r in rows(rank_within(df, ["k"], ["v", "i"]).select("k", "v", "i", "rank"))} == want


def test_global_rank_with_mixed_directions(hot):
    data, df = hot
    want = {r: n for n, r in enumerate(sorted(data, key=lambda r: (-r[1], r[2])), 1)}
    got = rank_within(df, [], [F.desc("v"), F.asc("i")])
    assert {r[:3]: r[3] for r in rows(got.select("k", "v", "i", "rank"))} == want


def test_lag_and_running_sum_cross_partitions(hot):
    data, df = hot
    lagged = {r[0]: r[1] for r in rows(lag_within(df, ["k"], ["v", "i"], ["i"]).select("i", "prev_i"))}
    summed = {r[0]: r[1] for r in rows(Ordered(df, ["k"], ["v", "i"]).running_sum("v", "s").select("i", "s"))}
    for group in by_key(data).values():
        before, total = None, 0
        for v, i in group:
            total += v
            assert lagged[i] == before and summed[i] == total
            before = i


def test_null_keys_form_one_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k string, v int")
    assert sorted(rows(rank_within(df, ["k"], ["v"]).select("v", "rank"))) == [(1, 1), (2, 1), (3, 2)]


def test_order_statistics_match_interpolation(hot):
    data, df = hot
    got = {r["k"]: r for r in order_statistics(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for k, group in by_key(data).items():
        v = [x for x, _ in group]
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            at = p * (len(v) - 1)
            want = v[math.floor(at)] + (v[math.ceil(at)] - v[math.floor(at)]) * (at - math.floor(at))
            assert got[k][name] == pytest.approx(want)
    middles = {r["k"]: r["upper_median"] for r in upper_median(df, ["k"], "v").collect()}
    assert middles == {k: g[len(g) // 2][0] for k, g in by_key(data).items()}


def test_top_k_is_cut_before_the_shuffle(hot):
    _, df = hot
    out = top_k(df, ["k"], [F.desc("v"), F.asc("i")], 2)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert max(r["rank"] for r in out.collect()) == 2


def test_weighted_decay_equals_the_recurrence(hot):
    data, df = hot
    got = {r["k"]: r["ewma"] for r in weighted_decay(df, ["k"], ["v", "i"], "v", 0.3).collect()}
    for k, group in by_key(data).items():
        a = 0.0
        for v, _ in group:
            a += 0.3 * (v - a)
        assert got[k] == pytest.approx(a)


def test_trailing_window_edges(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 10, 1), (1, 109, 0), (1, 110, 0)], "id int, t long, s int")
    out = dict(rows(trailing_sum(df, ["id"], "t", "s", 100, "n").select("t", "n")))
    assert {t: n * 10 for t, n in out.items()} == {0: 0, 10: 10, 109: 10, 110: 0}


def test_neighbouring_18_digit_ids_stay_apart(spark):
    ids = spark.createDataFrame([(720575940628857210,)], "id long")
    edges = spark.createDataFrame([(720575940628857210, 1), (720575940628857211, 1), (-1, 1)], "pre long, n int")
    assert [r["known"] for r in J.mark(edges, "pre", ids, "known").orderBy(F.desc("pre")).collect()] == [False, True, False]


def test_weighted_channels_and_minimum(spark):
    e = spark.createDataFrame([(1, 2, 3, 0.3, 0.7), (1, 2, 7, 0.8, 0.2), (2, 1, 1, 1.0, 0.0)], "pre long, post long, n long, a double, b double")
    assert rows(A.weighted_channels(e, ["pre", "post"], ["a", "b"], "n", 2)) == [(1, 2, 10, 0.65, 0.35)]


def test_quality_profile_sees_list_elements(spark):
    df = spark.createDataFrame([([1.0, float("nan"), None], 3), ([-2.0], None)], "x array<double>, y int")
    got = {r["column"]: r for r in A.quality_profile(df).collect()}
    assert (got["x"]["n_values"], got["x"]["nulls"], got["x"]["non_finite"], got["x"]["negative"], got["x"]["min"]) == (3, 1, 1, 1, -2.0)
    assert (got["y"]["n_values"], got["y"]["nulls"]) == (1, 1)


def test_version_delta_classes(spark):
    a = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (2, 2, 1)], "pre long, post long, n long")
    b = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (3, 3, 2)], "pre long, post long, n long")
    got = {(r["pre"], r["post"]): (r["cls"], r["delta"]) for r in J.version_delta(a, b, ["pre", "post"]).collect()}
    assert got == {(1, 1): ("both_same", 0), (1, 2): ("both_different", 1), (2, 2): ("only_a", -1), (3, 3): ("only_b", 2)}


def test_join_checked_rejects_duplicates(spark):
    left = spark.createDataFrame([(1, "a")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, r string")
    with pytest.raises(ValueError):
        J.join_checked(left, right, ["k"])
    assert J.join_checked(right, left, ["k"]).count() == 2


def test_resolution_skips_ambiguous_methods(spark):
    requests = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "request_id long, old_id long")
    walk = spark.createDataFrame([(10, 100, "a"), (10, 101, "a"), (10, 100, "b"), (20, 200, "a"), (20, 201, "b")], "old_id long, new_id long, method string")
    got = {r["request_id"]: (r["new_id"], r["method"], r["conflict"]) for r in J.resolve_ids(requests, walk, ["a", "b"]).collect()}
    assert got == {1: (100, "b", False), 2: (200, "a", True), 3: (None, "unresolved", False)}


EDGES = "pre long, post long, n long"


def test_paths_of_one_version_only(spark):
    e = spark.createDataFrame([(1, 2, 5, None), (2, 3, None, 5), (1, 4, 5, 1), (4, 3, 6, None)], "pre long, post long, a long, b long")
    ids = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(3,)], "id long")
    got = G.paths(e, *ids, 2, ("a", "b"), same_version_at=5)
    assert [(r["source"], r["mid"], r["target"]) for r in got.collect()] == [(1, 4, 3)]


def test_paths_match_enumeration(spark):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(40)})
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], EDGES)
    src, dst = {0, 1, 2}, {2, 3, 4}
    frames = [spark.createDataFrame([(x,) for x in s], "id long") for s in (src, dst)]
    step = {}
    for a, b in edges:
        step.setdefault(a, []).append(b)
    def walk(path, k):
        if k == 0:
            return [path] if path[-1] in dst else []
        return [p for b in step.get(path[-1], []) if b not in path for p in walk([*path, b], k - 1)]
    for k, cols in ((1, ["source", "target"]), (2, ["source", "mid", "target"]), (3, ["source", "mid", "mid2", "target"])):
        want = sorted(tuple(p) for s in src for p in walk([s], k))
        assert sorted(rows(G.paths(df, *frames, k).select(*cols))) == want


def test_hops_and_paths(spark):
    e = spark.createDataFrame([(1, 2, 9), (2, 3, 4), (1, 3, 1), (5, 1, 9), (7, 8, 9)], EDGES)
    hops = G.hop_distance(e, spark.createDataFrame([(3,)], "id long"), 4, (1, 4))
    got = {(r["min_n"], r["id"]): (r["hops"], r["next_id"]) for r in hops.collect()}
    assert got == {(1, 3): (0, None), (1, 2): (1, 3), (1, 1): (1, 3), (1, 5): (2, 1), (4, 3): (0, None), (4, 2): (1, 3), (4, 1): (2, 2), (4, 5): (3, 1)}
    p = G.shortest_paths(hops.where("min_n = 4"), e, spark.createDataFrame([(5,)], "id long"))
    assert [(r["nodes"], r["bottleneck"]) for r in p.collect()] == [([5, 1, 2, 3], 4)]


def test_ablation_never_adds_reach(spark):
    p = spark.createDataFrame([(1, 2, 3), (1, 4, 3), (1, 2, 5)], "source long, mid long, target long")
    removed = spark.createDataFrame([(1, "m", 2), (1, "none", 99), (1, "source", 1)], "source long, condition string, node long")
    none = spark.createDataFrame([], "source long, target long")
    got = {r["condition"]: r for r in G.ablate(p, removed, none).collect()}
    assert (got["m"]["paths_after"], got["m"]["targets_lost"]) == (1, 1)
    assert (got["none"]["paths_after"], got["none"]["targets_after"]) == (3, 2)
    assert (got["source"]["paths_after"], got["source"]["targets_lost"]) == (0, 2)
    # A direct edge keeps a target in reach, unless the source or the target itself goes.
    removed = removed.union(spark.createDataFrame([(1, "target", 5), (1, "far", 9)], removed.schema))
    direct = spark.createDataFrame([(1, 5), (1, 9)], "source long, target long")
    got = {r["condition"]: r for r in G.ablate(p, removed, direct).collect()}
    assert (got["m"]["targets_before"], got["m"]["paths_after"], got["m"]["targets_lost"]) == (3, 1, 0)
    assert [got[c]["targets_lost"] for c in ("none", "source", "target", "far")] == [0, 3, 1, 1]


def test_adjacency_splits_hubs(spark):
    e = spark.createDataFrame([(1, i, 1) for i in range(10)] + [(2, 3, 7)], EDGES)
    got = {(r["pre"], r["chunk"]): (r["n_items"], r["neighbours"]) for r in G.adjacency(e, chunk=4).collect()}
    assert got == {(1, 0): (4, "0:1;1:1;2:1;3:1"), (1, 1): (4, "4:1;5:1;6:1;7:1"), (1, 2): (2, "8:1;9:1"), (2, 0): (1, "3:7")}


@pytest.mark.parametrize("shape", ["spread", "clustered"])
def test_nearest_node_matches_brute_force(spark, shape, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF", 8)  # so that the large neuron takes the tree
    rng = random.Random(11)
    def place():
        if shape == "clustered" and rng.random() < 0.7:
            return tuple(1000 + rng.randrange(4) * 0.25 for _ in range(3))
        return tuple(float(rng.randrange(2000)) for _ in range(3))
    nodes = [("big" if i % 3 else f"n{i % 5}", i, *place()) for i in range(400)]
    sites = [("big" if i % 2 else f"n{i % 7}", i, *place()) for i in range(150)]
    tree = spark.createDataFrame(nodes, "neuron string, node_id long, x double, y double, z double")
    df = nearest_node(spark.createDataFrame(sites, "neuron string, s long, x double, y double, z double"), tree, ["s"])
    got = {r["s"]: (r["near_id"], r["near_dist"]) for r in df.collect()}
    for neuron, s, *at in sites:
        options = sorted((math.dist(at, n[2:]), n[1]) for n in nodes if n[0] == neuron)
        if not options:
            assert got[s] == (None, None)
        else:
            assert got[s][1] == pytest.approx(options[0][0]) and got[s][0] == options[0][1]


def test_nearest_segment_clamps_to_ends(spark):
    tree = spark.createDataFrame([("a", 1, -1, 0.0, 0.0, 0.0), ("a", 2, 1, 10.0, 0.0, 0.0), ("a", 3, 9, 5.0, 5.0, 0.0)],
                                 "neuron string, node_id long, parent_id long, x double, y double, z double")
    sites = spark.createDataFrame([("a", 1, 5.0, 2.0, 0.0), ("a", 2, 13.0, 4.0, 0.0)], "neuron string, s long, x double, y double, z double")
    assert {r["s"]: (r["near_id"], r["near_dist"]) for r in nearest_segment(sites, tree, ["s"]).collect()} == {1: (2, 2.0), 2: (2, 5.0)}
    t = topology(tree).collect()[0]
    assert (t["n_nodes"], t["n_roots"], t["n_orphans"], t["cable"]) == (3, 1, 1, 10.0)


def test_nearest_contact_of_hot_key(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF", 4)
    rng = random.Random(2)
    cols = [f"{e}_{x}" for e in ("pre", "post") for x in "xyz"]
    def make(n):
        return [(1 if i % 3 else 2 + i % 4, i, *[float(rng.randrange(60)) for _ in cols]) for i in range(n)]
    a, b = make(80), make(120)
    schema = "k long, i long, " + ", ".join(f"{c} double" for c in cols)
    df = nearest_contact(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], ["i"], "i")
    got = {r["i"]: r["near_id"] for r in df.collect()}
    for k, i, *at in a:
        options = [(math.sqrt(sum((p - q) ** 2 for p, q in zip(at, c[2:])) / 2), c[1]) for c in b if c[0] == k]
        assert got[i] == (min(options)[1] if options else None)


def test_greedy_match_equals_sequential_choice(spark):
    rng = random.Random(8)
    src = [(i, "s" if i % 4 else "t", rng.randrange(4), rng.randrange(3)) for i in range(30)]
    cand = [(100 + i, "s" if i % 3 else "t", rng.randrange(5), rng.randrange(4)) for i in range(36)]
    schema = "id long, stratum string, in_degree long, out_degree long"
    got = {r["source"]: r["control"] for r in greedy_match(spark.createDataFrame(src, schema), spark.createDataFrame(cand, schema), ["stratum"]).collect()}
    cell = {}
    for c in cand:
        cell[c[1:]] = min(cell.get(c[1:], c[0]), c[0])
    used, want = set(), {}
    for i, stratum, a, b in src:
        options = [(round(abs(math.log1p(a) - math.log1p(c[2])) + abs(math.log1p(b) - math.log1p(c[3])), 9), cell[c[1:]], c[0])
                   for c in cand if c[1] == stratum and c[0] not in used]
        if options:
            want[i] = min(options)[2]
            used.add(want[i])
    assert got == want


def test_alignment_must_be_one_to_one(spark):
    raw = spark.createDataFrame([(1, 2, "None", 3), (1, 2, "A", 1)], "pre long, post long, region string, n long")
    pub = spark.createDataFrame([(1, 2, "UNASGD", 3), (1, 2, "A", 2)], "pre long, post long, region string, n long")
    assert [(r["region"], r["n_raw"], r["n_pub"]) for r in explain_residual(raw, pub).collect()] == [("A", 1, 2)]
    with pytest.raises(ValueError):
        explain_residual(raw.union(spark.createDataFrame([(1, 2, "", 1)], raw.schema)), pub)


def test_ledger_fails_on_a_false_check(spark):
    m = spark.createDataFrame([(3, 4)], "a long, b long")
    good = ledger(m, {"same": (F.col("a"), F.col("a"))})
    assert require_passed(good).count() == 1
    with pytest.raises(ValueError, match="differs"):
        require_passed(ledger(m, {"differs": (F.col("a"), F.col("b"))}))


def test_scrub(spark):
    texts = [(1, "see /home/ann/x and C:\\Users\\bob\\y"), (2, "key ghp_" + "a" * 36), (3, "https://chatgpt.com/c/0123456789abcdef-0?x 1"),
             (4, "-----BEGIN RSA PRIVATE KEY-----"), (5, "http://localhost:80/a")]
    got = {r["i"]: r for r in scrub_text(spark.createDataFrame(texts, "i int, t string"), "t").collect()}
    assert got[1]["t"] == "see <USER_HOME>/x and <USER_HOME>\\y" and got[1]["n_home"] == 2
    assert (got[2]["publishable"], got[2]["t"], got[2]["n_service_token"]) == (False, None, 1)
    assert got[3]["t"] == "<PRIVATE_SESSION_URL_REMOVED> 1"
    assert not got[4]["publishable"] and got[5]["n_local"] == 1


def test_columns(spark):
    df = spark.createDataFrame([(" NA ", 0.5, "t", "12"), ("x", 2.5 / 255, "FALSE", "1x")], "s string, p double, b string, i string")
    got = df.select(C.clean("s"), C.quantise_probability("p"), C.strict_bool("b"), C.strict_int("i")).collect()
    assert [tuple(r) for r in got] == [(None, 128, True, 12), ("x", 2, False, None)]
    with pytest.raises(Exception, match="unknown label"):
        df.select(*C.one_hot("s", ["x"])).collect()
    hashed = spark.createDataFrame([("",), ("a",), ("foobar",)], "s string").select(C.fnv1a("s"), fnv1a_udf("s")).collect()
    assert [tuple(r) for r in hashed] == [(2166136261, 2166136261), (0xE40C292C, 0xE40C292C), (0xBF9CF968, 0xBF9CF968)]
