"""Every registered query runs; those with SQL must equal DuckDB on the same tables."""

import pytest

from queries.registry import load
from tests.compare import compare, connect

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], ORACLES.get(name), sf) is None


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
