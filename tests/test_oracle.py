"""Every named query against its SQL, or for rows where there is no SQL."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(folder):
    with connect(folder) as opened:
        yield opened


def test_names_match():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, connection, name):
    found = compare(spark, connection, folder, name, entry.queries()[name], SQL[name])
    spark.catalog.clearCache()
    assert found is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_query_has_rows(spark, folder, name):
    assert entry.queries()[name](spark, folder).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
