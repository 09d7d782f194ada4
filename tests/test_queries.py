"""Every core query that has SQL gives the same rows as the SQL; the others run and keep their schema."""

import pytest

from prismlake.plans import core_queries

from compare import connect, same

QUERIES, SQL = core_queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf, con):
    same(spark, sf, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    df.limit(5).collect()


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "association_cells" in e.queries()
