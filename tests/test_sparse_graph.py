"""Queries on a graph in which every pair has one contact: no limit on counts may empty them."""

import os

import duckdb
import pytest

from check import compare, connect
from tractum.catalog import load

QUERIES, ORACLES = load()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sparse(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sparse")
    for name in os.listdir(SMALL):
        if name != "lineitem.parquet":
            os.symlink(f"{SMALL}/{name}", folder / name)
    duckdb.sql(f"""COPY (SELECT * FROM '{SMALL}/lineitem.parquet' WHERE (l_suppkey * 7 + l_partkey % 10 * 3) % 4 < 2
        QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey % 10 ORDER BY l_orderkey, l_linenumber) = 1) TO '{folder}/lineitem.parquet'""")
    return str(folder)


@pytest.fixture(scope="module")
def duck(sparse):
    con = connect(sparse)
    yield con
    con.close()


def same(spark, duck, sparse, key):
    problem, _ = compare(spark, duck, key, QUERIES[key], ORACLES[key], sparse)
    assert problem in ("", "no rows")
    return [r.asDict() for r in QUERIES[key](spark, sparse).collect()]


def test_empty_total_is_zero(spark, duck, sparse):
    rows = {r["name"]: r for r in same(spark, duck, sparse, "audit_cross_checks")}
    strong = rows["strong_edges_at_most_points"]
    assert strong["passed"] is True and strong["n_left"] == 0 < strong["n_right"]


def test_empty_mask_keeps_its_row(spark, duck, sparse):
    rows = {r["mask"]: r for r in same(spark, duck, sparse, "subgraph_profile")}
    assert len(rows) == 4 and [rows["inside_strong"][c] for c in ("n_rows", "weight", "n_pre", "n_post")] == [0, 0, 0, 0]


def test_isolates_are_judged_on_all_pairs(spark, duck, sparse):
    n_pairs = duck.execute("SELECT count(DISTINCT (l_suppkey, l_partkey % 10)) FROM lineitem").fetchone()[0]
    assert len(same(spark, duck, sparse, "touch_isolate")) < n_pairs


def test_degrees_of_sources_count_all_pairs(spark, duck, sparse):
    assert all(r["n_out"] > 0 for r in same(spark, duck, sparse, "cross_source_summary"))


def test_cohort_at_each_limit(spark, duck, sparse):
    """All nodes have outputs at the limit 1 and none above it, so nobody has a lonely peer."""
    assert same(spark, duck, sparse, "peer_cohort") == []


def test_cohort_takes_single_contacts(spark, sparse, tmp_path):
    """Node 1 (right) has one contact and node 9, made its peer, has none: the limit 1 finds the pair."""
    for name in os.listdir(sparse):
        if name not in ("lineitem.parquet", "supplier.parquet"):
            os.symlink(f"{SMALL}/{name}", tmp_path / name)
    duckdb.sql(f"COPY (SELECT * FROM '{sparse}/lineitem.parquet' WHERE l_suppkey <> 9) TO '{tmp_path}/lineitem.parquet'")
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST(3 AS BIGINT)::INTEGER AS s_nationkey) FROM '{SMALL}/supplier.parquet') TO '{tmp_path}/supplier.parquet'")
    rows = QUERIES["peer_cohort"](spark, str(tmp_path)).collect()
    assert {r.min_n for r in rows} == {1} and {r.id for r in rows} == {1, 3, 5, 7}


def test_matched_degrees_count_all_pairs(spark, duck, sparse):
    same(spark, duck, sparse, "matched_control")
    from tractum.catalog.joins import _matching_nodes
    from tractum.catalog.views import Tables

    assert all(r.out_degree > 0 for r in _matching_nodes(Tables(spark, sparse)).collect())


def test_matched_without_reuse_on_single_contacts(spark, duck, sparse):
    same(spark, duck, sparse, "matched_control_no_reuse")


def test_peer_support_takes_single_contacts(spark, duck, sparse):
    from tractum.catalog.aggs import _typed_edges
    from tractum.catalog.views import Tables

    assert not _typed_edges(Tables(spark, sparse)).isEmpty()
    same(spark, duck, sparse, "peer_support")
    assert " n >= " not in ORACLES["peer_support"]


def test_coverage_takes_single_contacts(spark, duck, sparse):
    assert any(r["in_a"] for r in same(spark, duck, sparse, "coverage_2x2"))


def test_paths_take_single_contacts(spark, duck, sparse):
    assert same(spark, duck, sparse, "paths_3hop")


def test_paths_from_lists_of_last_edges(spark, monkeypatch):
    """Lists of two last edges: every path once, with the counts of its edges."""
    from tractum.operators import graph as G

    monkeypatch.setattr(G, "LIST", 2)
    n = {(a, b): a * 10 + b for a in range(7) for b in range(7) if (a + b) % 3}
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    got = G.paths(spark.createDataFrame([(*e, c) for e, c in n.items()], "pre long, post long, n long"), ids(range(4)), ids(range(1, 7)), 3)
    want = [(s, a, b, t, n[s, a], n[a, b], n[b, t]) for s, a in n for a2, b in n for b2, t in n
            if a == a2 and b == b2 and s < 4 and t > 0 and len({s, a, b, t}) == 4]
    assert sorted((r.source, r.mid, r.mid2, r.target, r.n_1, r.n_2, r.n_3) for r in got.collect()) == sorted(want)


def test_strongest_paths(spark, duck, sparse):
    assert same(spark, duck, sparse, "topk_paths")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strongest_paths_by_listing(spark, seed):
    """Few counts and many ties; targets as mids, sources as targets, loops."""
    import random

    from tractum.operators import graph as G

    rng = random.Random(seed)
    n = {(rng.randrange(14), rng.randrange(14)): rng.randrange(1, 4) for _ in range(110)}
    sources, targets = rng.sample(range(14), 6), rng.sample(range(14), 9)
    want = {}
    for (s, a), x in n.items():
        for (a2, b), y in n.items():
            for (b2, t), z in n.items():
                if a == a2 and b == b2 and s in sources and t in targets and len({s, a, b, t}) == 4:
                    want.setdefault((s, t), []).append((-min(x, y, z), a, b))
    want = {(s, t, r + 1): p[1:] for (s, t), ps in want.items() for r, p in enumerate(sorted(ps)[:3])}
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    edges = spark.createDataFrame([(*e, c) for e, c in n.items()], "pre long, post long, n long")
    got = {(r.source, r.target, r["rank"]): (r.mid, r.mid2) for r in G.strongest_paths(edges, ids(sources), ids(targets), 3).collect()}
    assert got == want


@pytest.mark.parametrize("sizes", [{}, {"PATH_BLOCK": 40}, {"TWO_PATHS": 7, "CANDIDATES": 30}])
def test_strongest_paths_are_not_listed(spark, monkeypatch, sizes):
    """A few parts, pieces and candidates at once, targets that few paths reach: the same rows; and no join of paths."""
    import random

    from tractum.operators import graph as G
    from tractum.operators import strongest as S

    for name, value in sizes.items():
        monkeypatch.setattr(S, name, value)
    rng = random.Random(9)
    n = {(rng.randrange(30), rng.randrange(30)): rng.choice([1, 1, 1, 2, 5, 70]) for _ in range(240)} | {(3, 40): 2, (40, 41): 1, (5, 41): 3}
    sources, targets = [*range(12)], [*range(6, 30), 41]
    step = {}
    for (a, b), x in n.items():
        if a != b:
            step.setdefault(a, []).append((b, x))
    want = {}
    for s in sources:
        for a, x in step.get(s, ()):
            for b, y in step.get(a, ()):
                for t, z in step.get(b, ()):
                    if t in targets and len({s, a, b, t}) == 4:
                        want.setdefault((s, t), []).append((-min(x, y, z), a, b, x, y, z))
    want = {(s, t, r + 1): p[1:] for (s, t), ps in want.items() for r, p in enumerate(sorted(ps)[:3])}
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    out = G.strongest_paths(spark.createDataFrame([(*e, c) for e, c in n.items()], "pre long, post long, n long"), ids(sources), ids(targets), 3)
    assert {(r.source, r.target, r["rank"]): (r.mid, r.mid2, r.n_1, r.n_2, r.n_3) for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_mediators_take_single_contacts(spark, duck, sparse):
    assert same(spark, duck, sparse, "top_mediator")


def test_mediators_counted_from_degrees(spark):
    """A path that returns to a source which is a target itself is no path."""
    from tractum.operators import graph as G
    from tractum.operators import reach as R

    edges = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (1, 3, 1), (3, 4, 1), (3, 3, 1), (2, 4, 1), (1, 1, 1), (5, 2, 1)], "pre long, post long, n long")
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id long")
    counts = R.mid_paths(edges, ids(1, 5), ids(1, 4))
    assert {(r.source, r.mid): r.n_paths for r in counts.collect()} == {(1, 2): 1, (1, 3): 1, (5, 2): 2}
    assert {r.source: (r.mid, r.n_paths) for r in G.most_paths(counts).collect()} == {1: (2, 1), 5: (2, 2)}


def test_isolates_at_each_limit(spark, duck, sparse):
    rows = same(spark, duck, sparse, "isolates")
    assert {r["min_n"] for r in rows} == {2, 5, 10, 15} and len(rows) == 40


def test_hypotheses_take_single_contacts(spark, duck, sparse):
    assert all(r["hypothesis_rows"] > 0 for r in same(spark, duck, sparse, "review_queue"))


def test_repeated_pairs_are_strong(spark, duck, sparse):
    assert all(r["strong_pairs"] == 0 for r in same(spark, duck, sparse, "integrated_queue"))
    rows = [r.asDict() for r in QUERIES["integrated_queue"](spark, "/root/testdata/sf0.1").where("strong_pairs > 0").collect()]
    assert rows


def test_rollup_keeps_regions_and_unknown_ends(spark, tmp_path):
    """As many points as the table has, also those without a pre or post end; both scores, six axes."""
    for name in os.listdir(SMALL):
        if name != "lineitem.parquet":
            os.symlink(f"{SMALL}/{name}", tmp_path / name)
    duckdb.sql(f"""COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_partkey END AS l_partkey,
        CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_quantity + l_orderkey % 4 / 4.0 AS l_quantity) FROM '{SMALL}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'""")
    con = connect(str(tmp_path))
    rows = same(spark, con, str(tmp_path), "evidence_rollup")
    assert sum(r["n_items"] for r in rows) == con.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    assert any(r["pre"] is None and r["post"] is None for r in rows)
    assert {"region", "prob_min", "prob_mean", "prob_max", "post_cx", "post_cy", "post_cz"} <= set(rows[0])
    con.close()


def test_coverage_at_each_limit(spark, duck, sparse):
    """Every node has single contacts in some version and no more than that."""
    rows = same(spark, duck, sparse, "coverage_2x2")
    assert {r["min_n"] for r in rows} == {1, 5, 10}
    assert all(r["in_a"] is False and r["in_b"] is False for r in rows if r["min_n"] > 1) and any(r["in_b"] for r in rows if r["min_n"] == 1)


def test_queue_at_each_limit(spark, duck, sparse):
    rows = same(spark, duck, sparse, "integrated_queue")
    assert {r["min_n"] for r in rows} == {2, 5, 10, 15}
    assert all(r["single_pairs"] == r["pairs"] + r["self_pairs"] > 0 for r in rows)
    assert all(sorted(r["review_rank"] for r in rows if r["min_n"] == x) == list(range(1, len(rows) // 4 + 1)) for x in (2, 5, 10, 15))
