"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.check import compare, oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in SQL:
        assert compare(df, con, SQL[name]) == ""
    else:
        assert df.toArrow().num_rows > 0


def test_entry(spark):
    assert entry.entry(spark).toArrow().num_rows > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
