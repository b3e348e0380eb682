"""Every query with SQL gives what DuckDB gives on the same tables."""

import pytest

from pagewright.plans import registry


#: Queries that SQL can't express at whole texts; test_whole.py holds them against plain Python.
NO_SQL = {"fnv1a64_per_image"}


def test_every_query_has_sql():
    assert sorted(set(registry.QUERIES) - NO_SQL) == sorted(registry.SQL)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_twin(twin, name):
    ours, theirs = twin(registry.QUERIES[name], registry.SQL[name])
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
    assert ours[1]
