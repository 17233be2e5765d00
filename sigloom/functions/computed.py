"""Computed columns: declarations turned into expressions.

Declarations may use columns declared before them. They are put into one another here, so that a table gets all its
computed columns in a single projection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import add, mul
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalars import to_number

Resolve = Callable[[str], Column]


def _difference(spec: Mapping[str, Any], col: Resolve) -> Column:
    return col(spec["left"]) - col(spec["right"])


def _sum(spec: Mapping[str, Any], col: Resolve) -> Column:
    return reduce(add, map(col, spec["columns"]))


def _product(spec: Mapping[str, Any], col: Resolve) -> Column:
    return reduce(mul, map(col, spec["columns"]))


def _ratio(spec: Mapping[str, Any], col: Resolve) -> Column:
    return F.try_divide(col(spec["numerator"]), col(spec["denominator"]))


def _weighted_sum(spec: Mapping[str, Any], col: Resolve) -> Column:
    return reduce(add, (col(name) * float(w) for name, w in spec["weights"].items()))


def _composite_mean(spec: Mapping[str, Any], col: Resolve) -> Column:
    """The mean of the parts that are there; it is over their number, whatever their weights."""
    parts = []
    for part in spec["components"]:
        x = col(part["column"])
        if part.get("invert"):
            x = float(part.get("max_value", 10)) + float(part.get("min_value", 0)) - x
        parts.append(x * float(part.get("weight", 1.0)))
    total = reduce(add, (F.coalesce(x, F.lit(0.0)) for x in parts))
    return F.try_divide(total, reduce(add, (x.isNotNull().cast("double") for x in parts)))


COMPUTED: dict[str, Callable[[Mapping[str, Any], Resolve], Column]] = {
    "difference": _difference,
    "sum": _sum,
    "product": _product,
    "ratio": _ratio,
    "weighted_sum": _weighted_sum,
    "composite_mean": _composite_mean,
}


def computed_columns(available: list[str], specs: list[Mapping[str, Any]]) -> dict[str, Column]:
    """Column name -> expression over the available columns, in the order of the declarations."""
    made: dict[str, Column] = {}

    def col(name: str) -> Column:
        if name in made:
            return made[name]
        if name not in available:
            raise ValueError(f"computed column needs a column that is not there: {name}")
        return to_number(F.col(f"`{name}`"))

    for spec in specs:
        if spec["type"] not in COMPUTED:
            raise ValueError(f"unknown type of computed column: {spec['type']}")
        made[spec["id"]] = COMPUTED[spec["type"]](spec, col)
    return made


def with_computed(df: DataFrame, specs: list[Mapping[str, Any]]) -> DataFrame:
    made = computed_columns(df.columns, specs)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[c.alias(name) for name, c in made.items()])
