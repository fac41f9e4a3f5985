"""The corpus queries that SQL can express equal their SQL counterparts."""

import pytest

from quantloom.llm import oracles, queries

from ..oracle import compare, connect


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_equals_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), connect(sf), oracles.ORACLES[name]) is None
