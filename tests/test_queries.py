"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as spark_entry
from oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(spark_entry.queries()))
def test_query(spark, con, name):
    query, sql = spark_entry.queries()[name], spark_entry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF_DIR).count() > 0
    else:
        assert difference(spark, con, SF_DIR, query, sql) is None


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_sql_names():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
