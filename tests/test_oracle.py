"""Every named query against its independent DuckDB statement."""

import os

import pytest
from oracle_compare import compare, duck

from hydrosight.plans.oracle import oracle_sql
from hydrosight.plans.queries import QUERIES

SF_DIR = os.environ.get("HYDROSIGHT_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(QUERIES[name](spark, SF_DIR), con, oracle_sql()[name])
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["exact"], r


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["SP_ID"] and df.count() > 0
    assert set(QUERIES) <= set(e.oracle_sql()) <= set(e.queries())
