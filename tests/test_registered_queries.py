"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as entry_points
from footfall.registry import QUERIES
from footfall.registry.oracle import ORACLE
from oracle_check import connect, difference



@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= entry_points.queries().items()
    assert ORACLE.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, connection, name):
    assert difference(QUERIES[name](spark, sf_dir), connection, ORACLE[name]) is None


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns[0] == "session_count"
    assert result.count() == 1
