"""Queries with SQL against DuckDB, and the columns of the others."""

import pytest

from pagewright.llm import oracles
from pagewright.llm import queries as own


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_twin(twin, name):
    ours, theirs = twin(own.QUERIES[name], oracles.SQL[name])
    assert ours == theirs
