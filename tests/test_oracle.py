"""Every registered query against DuckDB; whole tables of the smallest scale."""

import pytest

import __spark_entry__ as E
from tests import oracle

SLOW = {"detect_full", "benchmark_report", "supervised_head", "supervised_logistic"}
ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    assert oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    rows = E.entry(spark).collect()
    assert 0 < len(rows) <= 20
