"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle
from quarry.plans import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    good, note = oracle.compare(spark, duck, SF_DIR, QUERIES[name], ORACLES[name])
    assert good, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
