"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference
from rolesieve.catalog import oracles, queries as registered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, con, name):
    assert difference(entry_points.queries()[name](spark, SF), con, entry_points.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(registered.queries()) == set(oracles.oracle_sql())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and [r.is_fortune_500 for r in rows] == sorted((r.is_fortune_500 for r in rows), reverse=True)
