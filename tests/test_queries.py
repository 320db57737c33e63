"""Every registered query against its SQL on the smallest data."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry_point
from assaylens.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry_point.queries()[name](spark, SF)
    assert compare(df, con, entry_point.oracle_sql()[name]) is None


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns[0] == "feature"
    assert len(df.collect()) > 0
