"""Every named query against its SQL, and the shape of those without SQL."""

import os

import pytest
from compare import database, differences

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert differences(spark, con, entry.queries()[name], SQL[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
