"""Every registered query equals its SQL definition in DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from tracewell.plans.registry import QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
# The queries of the library itself; an optional subpackage has tests of its own.
OWN = set(QUERIES)
# Windows or rules that select nothing at this size.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(OWN & set(SQL)))
def test_query(spark, duck, name):
    diff = compare(entry.queries()[name](spark, SF), duck, SQL[name])
    assert diff is None or (diff == "EMPTY" and name in MAY_BE_EMPTY), diff


def test_all_queries_have_an_oracle():
    assert OWN <= set(SQL)
    assert OWN <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
