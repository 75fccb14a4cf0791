"""Queries that SQL can express, against DuckDB."""

import pytest

from veilspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(same_as_duckdb, name):
    same_as_duckdb(queries.QUERIES[name], queries.ORACLES[name])


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in queries.QUERIES
