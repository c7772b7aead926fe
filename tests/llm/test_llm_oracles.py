"""Queries that SQL can express agree with DuckDB."""

import compare
import pytest

from tallywright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, name):
    assert compare.differences(QUERIES[name](spark, SF), compare.duck(SF), ORACLES[name]) == ""
