"""The driver contract: every query runs, and equals its DuckDB oracle on the smallest tables."""

import os

import pytest
from check_oracles import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return duck(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF).count() > 0     # what the rows hold is asserted in the tests of their operator
    else:
        assert compare(spark, db, name, query, sql, SF) is None
