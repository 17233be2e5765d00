"""Ranks, running sums and quantiles of groups of any size: no group comes together in one task.

A group's distinct values are cut into parts by approximate quantiles; any cuts give right results, as the sums of the
parts are exact and only say how even the parts are. A part is ordered by a window of its own, and the sums of the parts
before it are added. Tables of up to PART rows are ordered by one window: the size is looked at, not assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.storage import discard, materialize

#: Distinct values that one task may order.
PART = 200_000
CUTS = 255
#: Of sketches: ranks are within one in so many. Groups of up to SMALL rows are bracketed whole.
ACCURACY = 10_000
SMALL = 50_000


def ordered(values: DataFrame, by: list[str], value: str, sums: list[str], part: int | None = None) -> DataFrame:
    """values: one row for each (by, value), value a double. Adds for each column s of sums `s_before`, the sum over the
    group's smaller values, and `s_all`, the sum over the group.

    values is read up to four times, so it should be a written table.
    """
    part = part or PART
    group = Window.partitionBy(*by)
    if values.count() <= part:
        before = group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return values.select("*", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums], *[F.sum(s).over(group).alias(f"{s}_all") for s in sums])
    large = values.groupBy(*by).count().where(F.col("count") > part).select(*by)
    cuts = values.join(large, by, "left_semi").groupBy(*by).agg(F.percentile_approx(value, [k / (CUTS + 1) for k in range(1, CUTS + 1)], 10 * CUTS).alias("_cuts"))
    at = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))
    placed = values.join(cuts, by, "left").withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(at)).drop("_cuts")
    totals = placed.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])  # CUTS + 1 rows a group
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}_off") for s in sums], *[F.sum(f"_{s}").over(group).alias(f"{s}_all") for s in sums])
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    both = placed.join(totals.hint("merge"), [*by, "_part"])  # values are never broadcast: a task then would have them all
    return both.select(*values.columns, *[(F.col(f"_{s}_off") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"{s}_before") for s in sums], *[f"{s}_all" for s in sums])


def ranked_pairs(both: DataFrame, by: list[str], part: int | None = None, places: bool = False) -> DataFrame:
    """both (by, x, y) -> a row for each distinct (by, x, y):

    m rows have it; n is the group's rows; a and b are twice the mean ranks (ties share theirs) less n, so they are whole
    numbers. With places also nx and ny, the rows with this x and y, dx and dy, the group's distinct x and y, and px and py,
    the rows with a smaller x and y.
    """
    cells = materialize(both.groupBy(*by, "x", "y").agg(F.count("*").alias("m")), "cells")
    if not places and cells.count() <= (part or PART):
        group = Window.partitionBy(*by)
        n = F.sum("m").over(group)
        rank = lambda v: 2 * F.sum("m").over(group.orderBy(v).rangeBetween(Window.unboundedPreceding, 0)) - F.sum("m").over(Window.partitionBy(*by, v)) + 1 - n
        return cells.select(*by, "x", "y", "m", n.alias("n"), rank("x").alias("a"), rank("y").alias("b"))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("v")) for s in ("x", "y")])
    values = cells.select(*by, "m", F.inline(sides)).groupBy(*by, "side", "v").agg(F.sum("m").alias("c"), F.lit(1).cast("long").alias("one"))
    values = materialize(values, "values")
    found = materialize(ordered(values, [*by, "side"], "v", ["c", "one"], part), "places")
    rank = 2 * F.col("c_before") + F.col("c") + 1 - F.col("c_all")
    of = lambda s, code: found.where(F.col("side") == s).select(*by, F.col("v").alias(s), rank.alias(code), F.col("c").alias(f"n{s}"), F.col("one_all").alias(f"d{s}"), F.col("c_before").alias(f"p{s}"), *([F.col("c_all").alias("n")] if s == "x" else []))
    # the size of a written table is that of its files; a broadcast is many times that, so rows are merged
    out = materialize(cells.join(of("x", "a").hint("merge"), [*by, "x"]).join(of("y", "b").hint("merge"), [*by, "y"]), "ranked")
    discard(cells, values, found)
    return out


def exact_quantiles(rows: DataFrame, by: list[str], value: str, asked: list[float]) -> DataFrame:
    """(by, q: array) with the quantiles asked for of each group's non-null values, as percentile() gives them.

    A first pass brackets each quantile by a sketch; in the second, values outside of all brackets are counted under the
    nearest bracket's end, which leaves the order of what is inside. So of a group's values about eight in ACCURACY come
    together for each quantile; all else is counted before the shuffle.
    """
    near = 4.0 / ACCURACY  # the sketch is off by one in ACCURACY at most
    ends = [p for q in asked for p in (max(0.0, q - near), min(1.0, q + near))]
    there = rows.where(F.col(value).isNotNull())
    cuts = there.groupBy(*by).agg(F.percentile_approx(value, ends, ACCURACY).alias("_ends"), F.min(value).alias("_min"), F.max(value).alias("_max"), F.count("*").alias("_rows"))
    v = F.col(value)
    low = [F.col("_min") if q <= near else F.col("_ends")[2 * k] for k, q in enumerate(asked)]
    high = [F.col("_max") if q >= 1 - near else F.col("_ends")[2 * k + 1] for k, q in enumerate(asked)]
    inside = F.col("_rows") <= SMALL
    for a, b in zip(low, high, strict=True):
        inside = inside | ((v >= a) & (v <= b))
    # outside: the greatest end below it, or the group's least value
    under = F.greatest(F.col("_min"), *[F.when(e < v, e) for e in (*low, *high)])
    counted = there.join(cuts, by).groupBy(*by, F.when(inside, v).otherwise(under).alias("_v")).agg(F.count("*").alias("_n"))
    return counted.groupBy(*by).agg(F.percentile("_v", F.array(*map(F.lit, asked)), F.col("_n")).alias("q"))
