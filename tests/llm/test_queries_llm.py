"""Queries with SQL give the SQL's rows; the others run."""

import pytest
from compare import connect, same

from prismlake.llm import llm_queries

QUERIES, SQL = llm_queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf):
    same(spark, sf, connect(sf), QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ["p1_entities", "p2_groups", "p3_found", "p6_found", "p7_fill", "p8_shares"])
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).limit(3).collect()
