"""Every registered query against its SQL twin on DuckDB."""

import os

import pytest

from check import compare, connect
from tractum.catalog import load

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    problem, _ = compare(spark, duck, key, QUERIES[key], ORACLES.get(key), SF_DIR)
    if problem == "no rows":
        pytest.skip("no rows at this scale")
    assert not problem


def test_entry(spark):
    import __spark_entry__

    assert not __spark_entry__.entry(spark).isEmpty()
