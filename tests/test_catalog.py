"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from sensorloom.catalog import load
from sensorloom.catalog.crosscheck import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = load().queries, load().sql


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert compare(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_no_orphans():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) <= {"boosted_forecast", "boosted_forecast_metrics"}
