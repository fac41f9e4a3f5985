"""Every catalog query equals its SQL counterpart."""

import pytest

from quantloom.plans import catalog

from .oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sf, con, name):
    assert compare(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    rows = catalog.QUERIES[name](spark, sf)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)
