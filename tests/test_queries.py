"""Every query with SQL equals that SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from compare import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert check(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["route", "airline", "n", "route_median", "p50", "p90", "p95"]
    assert df.count() > 0
