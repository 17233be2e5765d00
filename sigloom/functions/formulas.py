"""Formulas as pairs of columns: a value, and the reason why there is none.

A formula lists its faults in the order in which they are checked. The reason is the first fault that holds, else the
empty text, and the value is computed only where there is no fault: all stays inside generated code, also in ANSI mode.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Formula:
    """value and faults take (left, right)."""

    name: str
    value: Pair
    faults: tuple[tuple[str, Pair], ...] = ()

    def evaluate(self, left: Column, right: Column) -> tuple[Column, Column]:
        """(value, reason) of the formula for a left and a right column."""
        return settle([("missing_value", left.isNull() | right.isNull()), *[(why, fault(left, right)) for why, fault in self.faults]], self.value(left, right))


def settle(faults: list[tuple[str, Column]], value: Column) -> tuple[Column, Column]:
    """(value, reason) for faults that are checked in order."""
    reason = F.lit("")
    for why, fault in reversed(faults):
        reason = F.when(fault, F.lit(why)).otherwise(reason)
    return F.when(reason == "", value), reason


def _ratio(left: Column, right: Column) -> Column:
    return F.try_divide(left, right)


_FORMULAS = [
    Formula("delta", lambda l, r: l - r),
    Formula("percent_delta", lambda l, r: F.try_divide((l - r) * 100.0, F.abs(r)), (("percent_delta_division_by_zero", lambda l, r: r == 0),)),
    Formula("ratio", _ratio, (("ratio_division_by_zero", lambda l, r: r == 0),)),
    Formula("log_ratio", lambda l, r: F.ln(_ratio(l, r)), (("log_ratio_requires_positive_values", lambda l, r: (l <= 0) | (r <= 0)),)),
]
PAIRWISE: dict[str, Formula] = {f.name: f for f in _FORMULAS}
BASELINE = ("delta", "robust_z")


def register_formula(formula: Formula) -> None:
    """Make a formula of one's own known to all operations on pairs."""
    PAIRWISE[formula.name] = formula


def pairwise_formula(name: str) -> Formula:
    if name not in PAIRWISE:
        raise ValueError(f"unknown formula: {name}; known are {', '.join(PAIRWISE)}")
    return PAIRWISE[name]


def robust_z(value: Column, center: Column, spread: Column) -> tuple[Column, Column]:
    missing = value.isNull() | center.isNull() | spread.isNull()
    return settle([("missing_value", missing), ("robust_z_zero_scale", spread == 0)], F.try_divide(value - center, spread))


def baseline_formula(name: str, value: Column, center: Column, spread: Column) -> tuple[Column, Column]:
    if name == "delta":
        return PAIRWISE["delta"].evaluate(value, center)
    if name == "robust_z":
        return robust_z(value, center, spread)
    raise ValueError(f"unknown baseline formula: {name}; known are {', '.join(BASELINE)}")
