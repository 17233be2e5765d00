"""Every query of the engine against its SQL."""

import os

import duckdb
import pytest

from sigloom import oracles
from sigloom import queries as engine

SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def plain(rows):
    return sorted((tuple(repr(v + 0.0) if isinstance(v, float) else None if v is None else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, data, duck, name):
    df = engine.queries()[name](spark, data)
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    names = sorted(df.columns)
    at = [found.columns.index(c) for c in names]
    mine = plain([[r[c] for c in names] for r in df.collect()])
    assert mine == plain([[r[k] for k in at] for r in found.fetchall()])


def test_all_others_run(spark, data):
    for name in sorted(set(engine.queries()) - set(SQL)):
        assert engine.queries()[name](spark, data).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship_plan(spark, data):
    """One scan of the columns needed, one window for all statistics, no Python."""
    plan = engine.baseline_robust_z(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "props" not in plan
