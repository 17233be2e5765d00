"""Ranks and stability of large tables: rows are merged by shuffles, never broadcast, and not repeated level by level."""

import pytest
from pyspark.sql import functions as F

from sigloom.operators import analysis, ranks


@pytest.fixture(scope="module")
def both(spark):
    k = F.col("id")
    x, y = (k * 7919 % 211).cast("double"), F.when(k % 3 == 0, 4.0).otherwise((k * 104729 % 97).cast("double"))
    return spark.range(600).select(F.lit("t").alias("target"), F.lit("f").alias("feature"), x.alias("x"), y.alias("y"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_merged(both, monkeypatch):
    plans, write = {}, ranks.materialize
    monkeypatch.setattr(ranks, "materialize", lambda df, tag: (plans.update({tag: plan(df)}), write(df, tag))[1])
    ranks.ranked_pairs(both, ["target", "feature"], 50, places=True)
    assert "SortMergeJoin" in plans["ranked"] and "Broadcast" not in plans["ranked"]
    assert "BuildLeft" not in plans["places"]  # cuts may be broadcast, values may not


def test_stability_does_not_repeat_rows(both):
    ranked = ranks.ranked_pairs(both, ["target", "feature"], 50, places=True)
    out = analysis._left_out(ranked, ["target", "feature"], 50)
    assert "explode" not in plan(out)
    rows = both.toPandas()
    assert out.first().stability == analysis.leave_one_out(rows.x.to_numpy(), rows.y.to_numpy())
