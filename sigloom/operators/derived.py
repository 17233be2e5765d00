"""Derived-feature operations. Each gives canonical derived rows; what cannot be computed is a row with a reason.

All take optional entity keys, so many subjects are done side by side; without keys there is one subject. Operations
work on the long form (keys, date, feature, v), where a feature is a row: the window functions are keyed by entity and
feature, and no plan grows with the number of features.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.formulas import baseline_formula, pairwise_formula
from sigloom.schema import ORD, day_number, derived_row, iso, with_order

AGGREGATIONS = {
    "sum": F.sum,
    "mean": F.avg,
    "median": lambda c: F.percentile(c, 0.5),
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
}


def melt(df: DataFrame, keys: list[str], features: list[str], extra: Iterable[str] = ()) -> DataFrame:
    """(keys, date, _ord, extra, feature, v) for the features that df has; _ord 0 where df has none."""
    known = [f for f in features if f in df.columns]
    order = F.col(ORD) if ORD in df.columns else F.lit(0).cast("long").alias(ORD)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("v")) for f in known])
    return df.select(*keys, "date", order, *extra, F.inline(pairs))


def absent(df: DataFrame, keys: list[str], features: list[str], formulas: list[str], **texts: str) -> DataFrame | None:
    """Rows with reason feature_missing for the features that df does not have, or None."""
    lost = [f for f in features if f not in df.columns]
    if not lost:
        return None
    both = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(m).alias("formula")) for f in lost for m in formulas])
    rows = df.select(*keys, "date", F.inline(both))
    given = {k: F.lit(v) for k, v in texts.items()}
    given.setdefault("left_source", F.col("feature"))
    return rows.select(*derived_row(keys, date=iso("date"), feature=F.col("feature"), formula=F.col("formula"), valid=F.lit(False), reason=F.lit("feature_missing"), **given))


def _spread(results: dict[str, tuple[Column, Column]]) -> Column:
    """One row for each formula: formula, value, reason."""
    return F.inline(F.array(*[F.struct(F.lit(name).alias("formula"), value.cast("double").alias("value"), reason.alias("reason")) for name, (value, reason) in results.items()]))


def _finish(rows: DataFrame, keys: list[str], operation: str, kind: str, **more: Column) -> DataFrame:
    given = {"date": iso("date"), "feature": F.col("feature"), "formula": F.col("formula"), "value": F.col("value"), "valid": F.col("reason") == "", "reason": F.col("reason")}
    return rows.select(*derived_row(keys, operation_id=F.lit(operation), operation_type=F.lit(kind), **given | more))


def _with(found: DataFrame, lost: DataFrame | None) -> DataFrame:
    return found if lost is None else found.unionByName(lost)


def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each entity and date."""
    df = df if ORD in df.columns else with_order(df)
    rank = F.row_number().over(Window.partitionBy(*keys, "date").orderBy(ORD))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


# ---------------------------------------------------------------- pairs


def pairwise(
    left: DataFrame, right: DataFrame, spine: DataFrame, features: list[str], formulas: list[str], *, operation: str, left_source: str, right_source: str, keys: list[str] | None = None,
    quality=None, policy: str = "valid_only",
) -> DataFrame:
    """A left against a right source on each date of the spine (keys, date).

    quality(feature, row): the reason against a feature of a row (a struct), '' if none. See quality.flag_reason().
    """
    keys = keys or []
    made = {f: pairwise_formula(f) for f in formulas}
    on = [*keys, "date"]
    known = [f for f in features if f in left.columns and f in right.columns]
    lost = [f for f in features if f not in known]
    # an absent feature is typed as missing, so all features take one way
    l = first_rows(left, keys).select(*on, F.struct("*").alias("l"))
    r = first_rows(right, keys).select(*on, F.struct("*").alias("r"))
    days = spine.select(*on).where(F.col("date").isNotNull()).distinct().join(l, on, "left").join(r, on, "left")
    why = quality or (lambda feature, row: F.lit(""))
    cells = [
        F.struct(
            F.lit(f).alias("feature"), F.lit(False).alias("lost"), F.col(f"l.`{f}`").cast("double").alias("lv"), F.col(f"r.`{f}`").cast("double").alias("rv"),
            F.concat_ws(";", F.nullif(why(f, F.col("l")), F.lit("")), F.nullif(why(f, F.col("r")), F.lit(""))).alias("q"),
        )
        for f in known
    ] + [F.struct(F.lit(f).alias("feature"), F.lit(True).alias("lost"), F.lit(None).cast("double").alias("lv"), F.lit(None).cast("double").alias("rv"), F.lit("").alias("q")) for f in lost]
    days = days.select(*on, F.col("l").isNull().alias("nl"), F.col("r").isNull().alias("nr"), F.inline(F.array(*cells)))
    gap = F.when(F.col("nl") & F.col("nr"), "missing_left_and_right").when(F.col("nl"), "missing_left").when(F.col("nr"), "missing_right").when(F.col("lost"), "feature_missing").otherwise("")
    results = {}
    for name, formula in made.items():
        value, reason = formula.evaluate(F.col("lv"), F.col("rv"))
        bad = F.col("q") != ""
        if policy == "valid_only":
            value, reason = F.when(~bad, value), F.when(bad, F.col("q")).otherwise(reason)
        else:
            reason = F.when(reason != "", reason).otherwise(F.col("q"))
        results[name] = F.when(gap == "", value), F.when(gap != "", gap).otherwise(reason)
    rows = days.select(*on, "feature", "lv", "rv", _spread(results))
    return _finish(rows, keys, operation, "pairwise", left_source=F.lit(left_source), right_source=F.lit(right_source), left_value=F.col("lv"), right_value=F.col("rv"))


def pairwise_derived(left: DataFrame, right: DataFrame, formulas: list[str], *, operation: str, left_source: str, right_source: str, base_formulas: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Formulas over the values of two earlier operations, matched on date, feature and formula."""
    keys = keys or []
    made = {f: pairwise_formula(f) for f in formulas}
    on = [*keys, "date", "feature", "formula"]

    def side(df: DataFrame, s: str) -> DataFrame:
        if base_formulas is not None:
            df = df.where(F.col("formula").isin(base_formulas))
        return df.select(*on, F.col("value").alias(f"{s}v"), F.col("valid").alias(f"{s}ok"))

    both = side(left, "l").join(side(right, "r"), on).withColumnRenamed("formula", "base")
    ok = F.col("lok") & F.col("rok")
    results = {}
    for name, formula in made.items():
        value, reason = formula.evaluate(F.col("lv"), F.col("rv"))
        results[name] = F.when(ok, value), F.when(ok, reason).otherwise("invalid_left_or_right_derived")
    rows = both.select(*keys, "date", "feature", "base", "lv", "rv", _spread(results))
    return _finish(rows, keys, operation, "pairwise_derived", date=F.col("date"), base_formula=F.col("base"), left_source=F.lit(left_source), right_source=F.lit(right_source), left_value=F.col("lv"), right_value=F.col("rv"))


def pairwise_columns(df: DataFrame, pairs: list[dict[str, str]], formulas: list[str], *, operation: str, keys: list[str] | None = None) -> DataFrame:
    """Formulas over pairs (feature, left, right) of columns of one row; a column that is absent counts as missing."""
    keys = keys or []
    made = {f: pairwise_formula(f) for f in formulas}

    def value(name: str) -> Column:
        return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast("double")

    cells = [F.struct(F.lit(p["feature"]).alias("feature"), F.lit(p["left"]).alias("ls"), F.lit(p["right"]).alias("rs"), value(p["left"]).alias("lv"), value(p["right"]).alias("rv")) for p in pairs]
    rows = df.select(*keys, "date", F.inline(F.array(*cells)))
    rows = rows.select("*", _spread({n: f.evaluate(F.col("lv"), F.col("rv")) for n, f in made.items()}))
    return _finish(rows, keys, operation, "pairwise_columns", left_source=F.col("ls"), right_source=F.col("rs"), left_value=F.col("lv"), right_value=F.col("rv"))


def lagged_pairwise(df: DataFrame, features: list[str], formulas: list[str], *, operation: str, lag_days: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Each value against that of exactly lag_days earlier (the first row of that day)."""
    keys = keys or []
    made = {f: pairwise_formula(f) for f in formulas}
    long = melt(df, keys, features)
    on = [*keys, "date", "feature"]
    # the first row of a day, missing or not: a null must not make way for a later row
    before = long.where(F.col("date").isNotNull()).groupBy(*on).agg(F.min_by(F.struct(F.col("v").alias("x")), ORD).alias("first"))
    before = before.select(*keys, F.date_add("date", lag_days).alias("date"), "feature", F.col("first.x").alias("rv"), F.lit(True).alias("hit"))
    rows = long.withColumnRenamed("v", "lv").join(before, on, "left")
    results = {}
    for name, formula in made.items():
        value, reason = formula.evaluate(F.col("lv"), F.col("rv"))
        results[name] = F.when(F.col("hit"), value), F.when(F.col("hit"), reason).otherwise("missing_lagged_day")
    rows = rows.select(*keys, "date", "feature", "lv", "rv", _spread(results))
    found = _finish(rows, keys, operation, "lagged_pairwise", left_source=F.col("feature"), right_source=F.concat("feature", F.lit(f":lag_{lag_days}d")), left_value=F.col("lv"), right_value=F.col("rv"))
    return _with(found, absent(df, keys, features, formulas, operation_id=operation, operation_type="lagged_pairwise", right_source=""))


# ---------------------------------------------------------------- trailing windows


def trailing(keys: list[str], days: int, include_current: bool):
    """The frame of the calendar days [d - days, d), or with d itself: keyed by entity and feature, one shuffle for all."""
    return Window.partitionBy(*keys, "feature").orderBy("_day").rangeBetween(-days, 0 if include_current else -1)


def _center(statistic: str, frame) -> Column:
    if statistic not in ("median", "mean"):
        raise ValueError(f"unknown statistic: {statistic}")
    return (F.percentile("v", 0.5) if statistic == "median" else F.avg("v")).over(frame)


def _spread_of(scale: str, frame) -> Column:
    if scale not in ("iqr", "std"):
        raise ValueError(f"unknown scale: {scale}")
    if scale == "std":
        return F.stddev_samp("v").over(frame)
    quarters = F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).over(frame)
    return quarters[1] - quarters[0]


@dataclass(frozen=True)
class Baseline:
    """Each value against the statistic of the same feature over the days before it."""

    operation: str
    features: tuple[str, ...]
    formulas: tuple[str, ...]
    profile: Mapping[str, Any]
    profile_name: str
    include_current: bool = False

    kind = "baseline_deviation"

    def results(self, figure) -> list[tuple[str, Column, Column, Column]]:
        """(formula, right value, value, reason) over v and figures(name, days, include_current)."""
        days, least = int(self.profile["window_days"]), int(self.profile["min_periods"])
        ask = lambda name: figure(name, days, self.include_current)
        enough = (ask("n") >= least) & F.col("_day").isNotNull()  # a row without a date has no days before it
        c, spread = (F.when(enough, ask(self.profile.get(k, usual))) for k, usual in (("statistic", "median"), ("scale", "iqr")))
        gap = F.when(~enough, "insufficient_baseline").when(c.isNull(), "invalid_baseline").otherwise("")
        out = []
        for f in self.formulas:
            value, reason = baseline_formula(f, F.col("v"), c, spread)
            out.append((f, c, F.when(gap == "", value), F.when(gap != "", gap).otherwise(reason)))
        return out

    def names(self) -> list[str]:
        return list(self.formulas)

    def right_source(self) -> str:
        return f"baseline:{self.profile_name}"


@dataclass(frozen=True)
class Rolling:
    """Aggregates over the days before each row."""

    operation: str
    features: tuple[str, ...]
    aggregations: tuple[str, ...]
    window_days: int
    min_periods: int = 1
    include_current: bool = False

    kind = "rolling_aggregate"

    def results(self, figure) -> list[tuple[str, Column, Column, Column]]:
        few = (figure("n", self.window_days, self.include_current) < self.min_periods) | F.col("_day").isNull()
        out = []
        for a in self.aggregations:
            x = figure(a, self.window_days, self.include_current)
            out.append((f"rolling_{self.window_days}d_{a}", F.lit(None), F.when(~few, x), F.when(few, "insufficient_window").when(x.isNull(), "invalid_aggregate").otherwise("")))
        return out

    def names(self) -> list[str]:
        return list(self.aggregations)

    def right_source(self) -> str:
        return f"previous_{self.window_days}d"


def _window_figure(name: str, frame) -> Column:
    if name == "n":
        return F.coalesce(F.count("v").over(frame), F.lit(0))
    if name == "iqr":
        return _spread_of(name, frame)
    if name not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation: {name}; known are {', '.join(AGGREGATIONS)}")
    return AGGREGATIONS[name](F.col("v")).over(frame)


def trailing_operations(df: DataFrame, operations: Sequence[Baseline | Rolling], keys: list[str] | None = None) -> DataFrame:
    """All operations over trailing windows in one pass: one exchange and one sort by entity and feature serve them all,
    each figure is worked out once, and each row of a feature gives the results of all operations that ask for it."""
    keys = keys or []
    for op in operations:
        if isinstance(op, Baseline):
            if op.profile.get("statistic", "median") not in ("median", "mean"):
                raise ValueError(f"unknown statistic: {op.profile['statistic']}")
            if op.profile.get("scale", "iqr") not in ("iqr", "std"):
                raise ValueError(f"unknown scale: {op.profile['scale']}")
    figures: dict[tuple, Column] = {}

    def figure(name: str, days: int, current: bool) -> Column:
        key = (name, days, current)
        figures.setdefault(key, _window_figure(name, trailing(keys, days, current)))
        return F.col(f"_{name}_{days}_{int(current)}")

    cells = []
    for op in operations:
        asked = F.col("feature").isin(*op.features)
        for formula, right, value, reason in op.results(figure):
            cell = F.struct(
                F.lit(op.operation).alias("op"), F.lit(op.kind).alias("kind"), F.lit(op.right_source()).alias("rs"), F.lit(formula).alias("formula"), right.cast("double").alias("rv"), value.cast("double").alias("value"), reason.alias("reason")
            )
            cells.append(F.when(asked, cell))
    known = list(dict.fromkeys(f for op in operations for f in op.features if f in df.columns))
    parts = []
    if known:
        long = melt(df, keys, known).withColumn("_day", day_number("date"))
        stats = long.select("*", *[c.alias(f"_{n}_{d}_{int(k)}") for (n, d, k), c in figures.items()])
        rows = stats.select(*keys, "date", "feature", F.col("v").alias("lv"), F.inline(F.array_compact(F.array(*cells))))
        given = {c: F.col(c) for c in ("feature", "formula", "value", "reason")}
        parts.append(rows.select(*derived_row(keys, date=iso("date"), operation_id=F.col("op"), operation_type=F.col("kind"), left_source=F.col("feature"), right_source=F.col("rs"), left_value=F.col("lv"), right_value=F.col("rv"), valid=F.col("reason") == "", **given)))
    for op in operations:
        lost = absent(df, keys, list(op.features), op.names(), operation_id=op.operation, operation_type=op.kind, right_source="")
        parts += [] if lost is None else [lost]
    return reduce(DataFrame.unionByName, parts)


def baseline_deviation(df: DataFrame, features: list[str], formulas: list[str], *, operation: str, profile: Mapping[str, Any], profile_name: str, include_current: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Every row of df against the days before it."""
    return trailing_operations(df, [Baseline(operation, tuple(features), tuple(formulas), profile, profile_name, include_current)], keys)


def source_baseline(
    df: DataFrame, features: list[str], formulas: list[str], *, operation: str, profile: Mapping[str, Any], profile_name: str, source: str, spine: DataFrame | None = None, include_current: bool = False, keys: list[str] | None = None,
    quality=None, policy: str = "valid_only",
) -> DataFrame:
    """The rows of a source: the first of each date of the spine is judged, dates without one give missing_source, and
    quality (see pairwise) applies to the judged row, not to its baseline."""
    keys = keys or []
    days, least = int(profile["window_days"]), int(profile["min_periods"])
    frame = trailing(keys, days, include_current)
    df = df if ORD in df.columns else with_order(df)
    known = [f for f in features if f in df.columns]
    why = quality or (lambda feature, row: F.lit(""))
    if known:
        df = df.withColumn("_q", F.create_map(*[x for f in known for x in (F.lit(f), why(f, F.struct(*df.columns)))]))
    want = (spine if spine is not None else df).select(*keys, "date").where(F.col("date").isNotNull()).distinct()
    lost = absent(want, keys, [f for f in features if f not in known], formulas, operation_id=operation, operation_type="baseline_deviation", left_source=source, right_source="baseline")
    if not known:
        return lost
    long = melt(df, keys, known, ["_q"]).withColumn("_day", day_number("date"))
    rank = F.row_number().over(Window.partitionBy(*keys, "feature", "date").orderBy(ORD))
    stats = long.select(
        *keys, "date", "feature", "v", F.element_at("_q", F.col("feature")).alias("q"), F.coalesce(F.count("v").over(frame), F.lit(0)).alias("n"), _center(profile.get("statistic", "median"), frame).alias("_c"),
        _spread_of(profile.get("scale", "iqr"), frame).alias("_s"), rank.alias("_rank"),
    ).where("_rank = 1")
    enough = F.col("n") >= least
    stats = stats.withColumns({"c": F.when(enough, F.col("_c")), "s": F.when(enough, F.col("_s")), "hit": F.lit(True)})
    stats = want.withColumn("feature", F.explode(F.array(*map(F.lit, known)))).join(stats, [*keys, "date", "feature"], "left")
    bad = (F.col("q") != "") if policy == "valid_only" else F.lit(False)
    gap = F.when(F.col("hit").isNull(), "missing_source").when(bad, F.col("q")).when(~enough, "insufficient_baseline").when(F.col("c").isNull(), "invalid_baseline").otherwise("")
    results = {}
    for f in formulas:
        value, reason = baseline_formula(f, F.col("v"), F.col("c"), F.col("s"))
        results[f] = F.when(gap == "", value), F.when(gap != "", gap).otherwise(reason)
    rows = stats.select(*keys, "date", "feature", F.col("v").alias("lv"), F.col("c").alias("rv"), F.col("hit").isNotNull().alias("there"), _spread(results))
    right = F.when(F.col("there"), f"baseline:{profile_name}").otherwise("baseline")
    return _with(_finish(rows, keys, operation, "baseline_deviation", left_source=F.lit(source), right_source=right, left_value=F.col("lv"), right_value=F.col("rv")), lost)


def rolling_aggregate(df: DataFrame, features: list[str], aggregations: list[str], *, operation: str, window_days: int, min_periods: int = 1, include_current: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Aggregates over the days before each row."""
    return trailing_operations(df, [Rolling(operation, tuple(features), tuple(aggregations), window_days, min_periods, include_current)], keys)
