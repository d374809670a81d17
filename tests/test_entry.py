"""Registered queries next to their SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, bag


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["k", "precision", "recall", "mrr", "queries"] and df.count() == 5


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, data, name):
    df = entry.queries()[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    if name not in entry.oracle_sql():
        assert sum(got[1].values()) > 0
        return
    cursor = sql.execute(entry.oracle_sql()[name])
    assert got == bag([d[0] for d in cursor.description], cursor.fetchall())
