"""Every registered query with SQL equals DuckDB; the others run and return rows."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, folder, duck):
    got = QUERIES[name](spark, folder).toPandas()
    assert compare(got, duck.execute(SQL[name]).df()) == ""
    assert len(got)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_returns_rows(name, spark, folder):
    assert QUERIES[name](spark, folder).limit(1).count() == 1


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["region_id", "day_idx"] and df.count() == 10
