"""The same comparison on a copy of the tables in which one key, source, user
or neuron holds a third of the rows."""

import pytest

from check import TABLES, compare, connect
from tractum.catalog import load

SOURCE = "/root/testdata/sf0.001"
HOT = {
    "lineitem": "l_suppkey = 7, l_partkey = 5, l_orderkey = 100",
    "events": "user_id = 3",
    "orders": "o_custkey = 11",
}
KEYS = [
    "rank_in_group", "ewma", "trailing_rate", "percentile_summary", "upper_median", "evidence_rollup", "adjacency", "nearest_in_key",
    "point_to_node", "claims_rollup", "resolve_ids", "dual_detector_review", "filter_rule_search", "share_of_total", "stream_ewma",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    import duckdb

    folder, con = str(tmp_path_factory.mktemp("skew")), duckdb.connect()
    for name in TABLES.split():
        changes = [c.split(" = ") for c in HOT.get(name, "").split(", ") if c]
        cases = ", ".join(f"CASE WHEN _row % 3 = 0 THEN {v} ELSE {c} END AS {c}" for c, v in changes)
        columns = f"* EXCLUDE (_row) REPLACE ({cases})" if changes else "* EXCLUDE (_row)"
        rows = f"(SELECT *, row_number() OVER () AS _row FROM '{SOURCE}/{name}.parquet')"
        con.execute(f"COPY (SELECT {columns} FROM {rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    con.close()
    return folder


@pytest.mark.parametrize("key", KEYS)
def test_skewed(spark, skewed, key):
    queries, oracles = load()
    con = connect(skewed)
    problem, n = compare(spark, con, key, queries[key], oracles[key], skewed)
    assert not problem and n
