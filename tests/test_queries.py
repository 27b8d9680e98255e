"""Every registered query equals its SQL, on the smallest given tables."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        # A count would let Spark leave out the columns that Python makes.
        rows = df.collect()
        assert rows and len(set(df.columns)) == len(df.columns)
        return
    message, _ = difference(connect(SF_DIR), df, sql)
    assert message is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
