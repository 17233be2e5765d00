import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigloom.functions.computed import with_computed
from sigloom.functions.formulas import PAIRWISE, Formula, baseline_formula, pairwise_formula, register_formula, robust_z
from sigloom.functions.scalars import sniff_numeric, to_number


def one(spark, name, left, right):
    df = spark.createDataFrame([(left, right)], "l double, r double")
    v, why = pairwise_formula(name).evaluate(F.col("l"), F.col("r"))
    return tuple(df.select(v, why).first())


@pytest.mark.parametrize(
    "name, left, right, expected",
    [
        ("delta", 3.0, 1.0, (2.0, "")),
        ("delta", None, 1.0, (None, "missing_value")),
        ("percent_delta", 3.0, -2.0, (250.0, "")),
        ("percent_delta", 3.0, 0.0, (None, "percent_delta_division_by_zero")),
        ("percent_delta", None, 0.0, (None, "missing_value")),
        ("ratio", 3.0, 2.0, (1.5, "")),
        ("ratio", 3.0, 0.0, (None, "ratio_division_by_zero")),
        ("log_ratio", math.e, 1.0, (1.0, "")),
        ("log_ratio", -1.0, 1.0, (None, "log_ratio_requires_positive_values")),
        ("log_ratio", 1.0, 0.0, (None, "log_ratio_requires_positive_values")),
    ],
)
def test_pairs(spark, name, left, right, expected):
    assert one(spark, name, left, right) == pytest.approx(expected)


@pytest.mark.parametrize("v, c, s, expected", [(5.0, 3.0, 2.0, (1.0, "")), (5.0, 3.0, 0.0, (None, "robust_z_zero_scale")), (5.0, 3.0, None, (None, "missing_value"))])
def test_robust_z(spark, v, c, s, expected):
    df = spark.createDataFrame([(v, c, s)], "v double, c double, s double")
    assert tuple(df.select(*robust_z(F.col("v"), F.col("c"), F.col("s"))).first()) == expected


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError):
        pairwise_formula("no such")
    with pytest.raises(ValueError):
        baseline_formula("ratio", F.lit(1.0), F.lit(1.0), F.lit(1.0))


def test_own_formula(spark):
    register_formula(Formula("half_sum", lambda l, r: (l + r) / 2))
    try:
        assert one(spark, "half_sum", 1.0, 3.0) == (2.0, "")
    finally:
        del PAIRWISE["half_sum"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.none() | st.floats(-1e6, 1e6), st.none() | st.floats(-1e6, 1e6)), min_size=1, max_size=20))
def test_delta_is_antisymmetric_and_valid_means_no_reason(spark, rows):
    df = spark.createDataFrame(rows, "l double, r double")
    a, why = pairwise_formula("delta").evaluate(F.col("l"), F.col("r"))
    b, _ = pairwise_formula("delta").evaluate(F.col("r"), F.col("l"))
    for x, y, reason in df.select(a, b, why).collect():
        assert (x is None) == (reason != "") and (x is None or x == -y)


def test_computed(spark):
    df = spark.createDataFrame([("1", "2", None), ("x", "0", "4")], "a string, b string, c string")
    specs = [
        {"id": "s", "type": "sum", "columns": ["a", "b"]}, {"id": "r", "type": "ratio", "numerator": "s", "denominator": "b"},
        {"id": "m", "type": "composite_mean", "components": [{"column": "a"}, {"column": "b", "invert": True, "max_value": 10, "min_value": 0}, {"column": "c", "weight": 2}]},
    ]
    assert [tuple(r)[3:] for r in with_computed(df, specs).collect()] == [(3.0, 1.5, 4.5), (None, None, 9.0)]
    with pytest.raises(ValueError):
        with_computed(df, [{"id": "z", "type": "sum", "columns": ["nothing"]}])
    with pytest.raises(ValueError):
        with_computed(df, [{"id": "z", "type": "power"}])


def test_sniffing(spark):
    df = spark.createDataFrame([("1,5", "10:30", "a"), ("2", "11:00", "1"), (None, "9:15", "b"), ("x", "", "c")] + [("3", "8:00", "d")] * 4, "num string, clock string, word string")
    assert sniff_numeric(df) == ["num"]
    assert spark.range(1).select(to_number(F.lit("NaN")), to_number(F.lit("4.5 "))).first()[0] is None
