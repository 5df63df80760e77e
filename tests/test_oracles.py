"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
check), and rows-only queries produce rows."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck_conn  # noqa: E402

SF = "/root/testdata/sf0.01"
QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert r["status"] in ("ok", "rows-only"), r
    if r["status"] == "rows-only":
        assert r["rows"] > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["head", "n", "own_type"]
