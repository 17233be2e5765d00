"""Reasons and corner cases of the derived operations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sigloom.operators import derived
from sigloom.operators.quality import flag_reason
from sigloom.schema import DERIVED_COLUMNS

PROFILE = {"window_days": 7, "min_periods": 2, "statistic": "median", "scale": "iqr"}


def day(n):
    return dt.date(2024, 1, n)


def table(spark, rows):
    return spark.createDataFrame([(k, day(d) if d else None, v) for k, (d, v) in enumerate(rows)], "_ord long, date date, v double")


def got(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(F.col("date").asc_nulls_last(), "feature", "formula", "value").collect()]


def test_lag_is_by_calendar_day_and_first_row(spark):
    df = table(spark, [(1, 1.0), (2, 5.0), (2, 9.0), (4, 7.0), (None, 3.0)])
    out = derived.lagged_pairwise(df, ["v", "gone"], ["delta"], operation="o")
    rows = [r for r in got(out, "date", "feature", "right_value", "value", "reason") if r[1] == "v"]
    assert rows == [("2024-01-01", "v", None, None, "missing_lagged_day"), ("2024-01-02", "v", 1.0, 4.0, ""), ("2024-01-02", "v", 1.0, 8.0, ""), ("2024-01-04", "v", None, None, "missing_lagged_day"), (None, "v", None, None, "missing_lagged_day")]
    assert out.where("feature = 'gone' AND reason = 'feature_missing' AND NOT valid").count() == 5
    assert tuple(out.columns) == DERIVED_COLUMNS


def test_a_missing_first_row_is_not_replaced(spark):
    df = table(spark, [(1, None), (1, 4.0), (2, 5.0)])
    assert got(derived.lagged_pairwise(df, ["v"], ["delta"], operation="o"), "date", "reason")[-1] == ("2024-01-02", "missing_value")


def test_baseline_reasons(spark):
    df = table(spark, [(1, 1.0), (2, 1.0), (3, 2.0), (4, None), (20, 5.0)])
    out = derived.baseline_deviation(df, ["v"], ["robust_z"], operation="o", profile=PROFILE, profile_name="p")
    assert got(out, "date", "reason", "valid") == [
        ("2024-01-01", "insufficient_baseline", False), ("2024-01-02", "insufficient_baseline", False), ("2024-01-03", "robust_z_zero_scale", False), ("2024-01-04", "missing_value", False), ("2024-01-20", "insufficient_baseline", False),
    ]


def test_window_bounds(spark):
    df = table(spark, [(1, 1.0), (8, 2.0), (9, 4.0)])
    ask = lambda current: got(derived.rolling_aggregate(df, ["v"], ["sum"], operation="o", window_days=7, include_current=current), "value")
    assert ask(False) == [(None,), (1.0,), (2.0,)]
    assert ask(True) == [(1.0,), (3.0,), (6.0,)]


def test_pairwise_reasons(spark):
    raw = spark.createDataFrame(
        [(0, day(1), "l", 1.0, True), (1, day(1), "r", 0.0, True), (2, day(2), "l", 1.0, True), (3, day(3), "r", 1.0, True), (4, day(4), "x", 1.0, True), (5, day(5), "l", 1.0, False), (6, day(5), "r", 2.0, None)],
        "_ord long, date date, side string, hrv_a double, hrv_validated boolean",
    )
    side = lambda s: raw.where(F.col("side") == s)
    ask = lambda policy: derived.pairwise(side("l"), side("r"), raw, ["hrv_a", "gone"], ["ratio"], operation="o", left_source="l", right_source="r", quality=flag_reason(raw.columns), policy=policy)
    rows = [r for r in got(ask("valid_only"), "date", "feature", "value", "reason") if r[1] == "hrv_a"]
    assert [r[3] for r in rows] == ["ratio_division_by_zero", "missing_right", "missing_left", "missing_left_and_right", "hrv_validated=false"]
    assert [r[3] for r in got(ask("valid_only"), "date", "feature", "value", "reason") if r[1] == "gone"] == ["feature_missing", "missing_right", "missing_left", "missing_left_and_right", "feature_missing"]
    kept = [r for r in got(ask("keep"), "date", "feature", "value", "valid", "reason") if r[1] == "hrv_a"]
    assert kept[-1] == ("2024-01-05", "hrv_a", 0.5, False, "hrv_validated=false")


def test_pairwise_derived_needs_both(spark):
    row = lambda v, ok: spark.createDataFrame([("2024-01-01", "f", "delta", v, ok)], "date string, feature string, formula string, value double, valid boolean")
    ask = lambda a, b: got(derived.pairwise_derived(a, b, ["delta"], operation="o", left_source="a", right_source="b"), "value", "reason", "base_formula")
    assert ask(row(3.0, True), row(1.0, True)) == [(2.0, "", "delta")]
    assert ask(row(3.0, True), row(None, False)) == [(None, "invalid_left_or_right_derived", "delta")]


def test_source_baseline_takes_spine(spark):
    src = table(spark, [(1, 1.0), (2, 3.0), (3, 5.0), (3, 99.0)])
    spine = spark.createDataFrame([(day(3),), (day(4),)], "date date")
    out = derived.source_baseline(src, ["v", "gone"], ["delta"], operation="o", profile=PROFILE, profile_name="p", source="s", spine=spine)
    assert got(out.where("feature = 'v'"), "date", "left_value", "right_value", "value", "reason", "right_source") == [("2024-01-03", 5.0, 2.0, 3.0, "", "baseline:p"), ("2024-01-04", None, None, None, "missing_source", "baseline")]
    assert out.where("feature = 'gone'").count() == 2


def test_order_of_rows_does_not_matter(spark):
    df = table(spark, [(k, float(k * k % 7)) for k in range(1, 25)])
    ask = lambda d: got(derived.baseline_deviation(d, ["v"], ["delta", "robust_z"], operation="o", profile=PROFILE, profile_name="p"), "date", "formula", "value", "reason")
    assert ask(df) == ask(df.orderBy(F.rand(3)).repartition(3))


def test_unknown_aggregate_raises(spark):
    with pytest.raises(ValueError):
        derived.rolling_aggregate(table(spark, [(1, 1.0)]), ["v"], ["mode"], operation="o", window_days=3)
    with pytest.raises(ValueError):
        derived.baseline_deviation(table(spark, [(1, 1.0)]), ["v"], ["delta"], operation="o", profile=PROFILE | {"statistic": "mode"}, profile_name="p")


def test_operations_share_one_exchange(spark):
    df = table(spark, [(k, float(k % 5)) for k in range(1, 20)])
    ops = [derived.Baseline("a", ("v",), ("delta", "robust_z"), PROFILE, "p"), derived.Rolling("b", ("v",), ("sum", "std"), 3), derived.Baseline("c", ("v",), ("delta",), PROFILE | {"window_days": 5}, "q", True)]
    out = derived.trailing_operations(df, ops)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1
    for op in ops:
        alone = derived.trailing_operations(df, [op])
        assert out.where(F.col("operation_id") == op.operation).exceptAll(alone).count() == 0 and alone.count() == out.where(F.col("operation_id") == op.operation).count()
