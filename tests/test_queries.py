"""Every registered query with a SQL twin gives the same rows; the others give a stable schema."""

import os

import duckdb
import pytest

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="session")
def db(small):
    con = duckdb.connect()
    for t in os.listdir(small):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{small}/{t}'")
    return con


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, small):
    assert __spark_entry__.entry(spark).count() > 0


def plain(v):
    return None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else bool(v) if type(v).__name__ == "bool" else str(v)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_query_equals_sql(spark, db, small, name):
    got = QUERIES[name](spark, small).toPandas()
    want = db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = sorted(repr(tuple(plain(v) for v in r)) for r in got[cols].astype(object).itertuples(index=False))
    b = sorted(repr(tuple(plain(v) for v in r)) for r in want[cols].astype(object).where(want[cols].notna(), None).itertuples(index=False))
    assert a == b


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith("p")))
def test_query_without_twin_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() >= 0 and df.columns


def test_recall_of_the_index(spark, small):
    assert QUERIES["ivf_recall"](spark, small).first().recall >= 0.9


def test_plans_push_down(spark, small):
    plan = QUERIES["snap_append_read"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    plan = QUERIES["scan_project"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan
