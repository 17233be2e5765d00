"""Feature analysis: association with targets, its stability, redundancy and ranks.

The protocol names these steps and their limits; their exact meaning is defined here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.ranks import PART, ordered, ranked_pairs
from sigloom.operators.reports import unpivot
from sigloom.ship import ship
from sigloom.storage import materialize

#: Rows of a block, and the most parts on a side of the grid of blocks: it has four million counts at most.
BLOCK = 50_000
GRID = 1024


def directed(column: Column, direction: str) -> Column:
    """A target turned so that more is worse."""
    return -column if direction == "higher_better" else column


def in_scope(catalog: DataFrame, ecg_only: bool = True, access: str = "all", exclude_roles: tuple[str, ...] = ("target", "meta", "qc", "technical"), manual: tuple[str, ...] = (), mode: str = "auto") -> DataFrame:
    """The features of the catalog to be analysed."""
    c = F.col("column")
    ok = ~F.col("role").isin(*exclude_roles)
    if ecg_only:
        ok = ok & F.col("source_table").isin("raw_ecg_features", "ecg_derived")
    if access == "delta":
        ok = ok & (F.col("source_table") == "ecg_derived")
    elif access in ("before", "after"):
        ok = ok & F.array_contains(F.split(c, "__"), access)
    if mode == "manual":
        ok = c.isin(*manual)
    elif mode == "auto_plus_manual":
        ok = ok | c.isin(*manual)
    return catalog.where(ok)


def pairs(df: DataFrame, row_id: list[str], targets: list[str], features: list[str]) -> DataFrame:
    """(row_id, target, feature, x, y) where both are there: a row joined with itself by exploding, without a join."""
    long = unpivot(df.select("*", *[F.col(f"`{t}`").cast("double").alias(f"_y{k}") for k, t in enumerate(targets)]), features, (*row_id, *[f"_y{k}" for k in range(len(targets))]))
    ys = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_y{k}").alias("y")) for k, t in enumerate(targets)])
    long = long.select(*row_id, F.col("column").alias("feature"), F.col("v").alias("x"), F.inline(ys))
    return long.where("x IS NOT NULL AND y IS NOT NULL")


def spearman(both: DataFrame, by: list[str] | None = None, part: int | None = None) -> DataFrame:
    """(by, n, rho) for rows with x and y; NULL where one of them does not vary. Ranks of ties are their mean.

    Ranks come from running sums over parts of each pair's distinct values (ranks.ordered), so no task sees a pair whole.
    """
    return correlations(ranked_pairs(both, by or ["target", "feature"], part), by or ["target", "feature"])


def correlations(ranked: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, rho) of ranked_pairs()."""
    m, a, b = (F.col(c).cast("double") for c in ("m", "a", "b"))
    a, b = a - 1, b - 1  # twice the distance from the mean rank
    per = ranked.groupBy(*by).agg(F.sum("m").alias("n"), F.sum(m * a * b).alias("xy"), F.sum(m * a * a).alias("xx"), F.sum(m * b * b).alias("yy"))
    return per.select(*by, "n", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt("xx") / F.sqrt("yy")).alias("rho"))


def dominated(x: np.ndarray, y: np.ndarray, m: np.ndarray, equal: bool = True) -> np.ndarray:
    """For each place the sum of m over all places, times 2 for a greater x and 1 for an equal one, and the same of y.
    Without `equal`, places of an equal x do not count.

    By the bits of x: two values first differ in some bit, and those that share the bits above it are looked at together
    in the order of y, so each bit is a pass of running sums.
    """
    _, px = np.unique(x, return_inverse=True)
    _, py = np.unique(y, return_inverse=True)
    out = np.zeros(len(x), np.int64)
    for level in range(-1 if equal else 0, int(px.max()).bit_length() if len(px) else 0):
        prefix, bit = (px, np.ones_like(px)) if level < 0 else (px >> (level + 1), px >> level & 1)
        order = np.lexsort((py, prefix))
        p, q, w = prefix[order], py[order], (m * bit)[order]
        sums = np.r_[0, np.cumsum(w)]
        group = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        run = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
        ends, last = np.r_[group[1:], len(p)], np.r_[run[1:], len(p)]
        at = np.searchsorted(run, np.arange(len(p)), side="right") - 1
        end = sums[ends[np.searchsorted(group, np.arange(len(p)), side="right") - 1]]
        got = 2 * (end - sums[last[at]]) + sums[last[at]] - sums[run[at]]
        out[order] += got if level < 0 else np.where(bit[order] == 0, 2 * got, 0)
    return out


def leave_one_out(x: np.ndarray, y: np.ndarray) -> float:
    """The share of rows without any one of which the rank correlation keeps its sign.

    Taking a row out lowers each rank above its own by one and each equal one by half. So the sum of products without it
    is that of all rows less sums over the rows above it in x, in y and in both: running sums, n log n steps in whole numbers.
    """
    n = len(x)
    if n < 2:
        return 0.0
    ones = np.ones(n, np.int64)
    both = []
    for v in (x, y):
        values, place, count = np.unique(v, return_inverse=True, return_counts=True)
        twice = (2 * np.cumsum(count) - count + 1)[place] - n
        both.append((len(values), place, count, twice))
    (dx, px, cx, a), (dy, py, cy, b) = both
    if dx < 2 or dy < 2:
        return 0.0
    wide = np.int64 if n < 1_000_000 else object  # sums grow with n cubed

    def above(place: np.ndarray, count: np.ndarray, w: np.ndarray) -> np.ndarray:
        per = np.bincount(place, w.astype(np.float64), len(count)).astype(np.int64)  # below n squared: exact in doubles
        run = np.cumsum(per[::-1])[::-1]
        return (2 * (run - per) + per)[place]

    a_, b_ = a.astype(wide), b.astype(wide)
    total = (a_ * b_).sum()
    left = total - a_ * b_ - (above(py, cy, a) - a) - (above(px, cx, b) - b) + (dominated(px, py, ones) - 1)
    varies = ~((dx == 2) & (cx[px] == 1)) & ~((dy == 2) & (cy[py] == 1))
    return float((varies & (np.sign(left) == np.sign(((a_ - 1) * (b_ - 1)).sum()))).sum()) / n


def _blocks(u: str, v: str, weight: str, own: str, equal: bool, names: tuple[str, str]):
    """Adds to the rows of a block dominated() of (u, v) and the sum of m times weight over its rows above in `own`."""

    def run(rows: pa.Table) -> pa.Table:
        of = lambda c: rows[c].to_numpy()
        _, place = np.unique(of(own), return_inverse=True)
        per = np.zeros(place.max() + 1, np.int64)
        np.add.at(per, place, of("m") * of(weight))
        above = (2 * (np.cumsum(per[::-1])[::-1] - per) + per)[place]
        found = dominated(of(u), of(v), of("m"), equal)
        return rows.append_column(names[0], pa.array(found)).append_column(names[1], pa.array(above))

    return run


def _beyond(grid: pa.Table) -> pa.Table:
    """Adds to the blocks of a group the rows in blocks that are later in both i and j."""
    i, j = (np.unique(grid[c].to_numpy(), return_inverse=True)[1] for c in ("i", "j"))
    sums = np.zeros((i.max() + 2, j.max() + 2), np.int64)
    np.add.at(sums, (i, j), grid["w"].to_numpy())
    sums = sums[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]
    return grid.append_column("beyond", pa.array(sums[i + 1, j + 1]))


def _left_out(ranked: DataFrame, by: list[str], part: int | None = None) -> DataFrame:
    """(by, stability) of ranked_pairs(): what leave_one_out() gives, by blocks of rows over the cluster.

    A group is cut into up to GRID parts by x, and by y; equal values stay together, and a value with more rows than a part
    is a part of its own. The rows above a row in both are those of its x part, counted in NumPy, those of its y part in
    later x parts, counted likewise, and those in parts that are later in both, from the counts of the grid of parts. So a
    row is shuffled once by each part, and a task holds a part at a time; a part of one value takes running sums.
    """
    schema = lambda df, *more: ", ".join([f"`{c}` {kind}" for c, kind in df.dtypes] + [f"{c} bigint" for c in more])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    n = F.col("n")
    parts = F.least(F.lit(GRID), F.ceil(n / min(part or BLOCK, BLOCK)))
    wide = lambda s: F.col(f"n{s}") * parts > n
    place = lambda s: 2 * F.floor(F.col(f"p{s}") * parts / n) + wide(s).cast("long")
    cells = ranked.withColumns({"wide_x": wide("x"), "wide_y": wide("y"), "i": place("x"), "j": place("y")})
    any_x, any_y = cells.agg(F.max("wide_x"), F.max("wide_y")).first()

    one = cells.where(~F.col("wide_x"))
    rows = one.groupBy(*by, "i").applyInArrow(_blocks("px", "py", "b", "px", True, ("in_x", "above_x")), schema(one, "in_x", "above_x"))
    if any_x:
        run = ordered(materialize(cells.where("wide_x"), "wide"), [*by, "x"], "y", ["m"], part)
        rows = rows.unionByName(run.select(*cells.columns, (2 * (F.col("m_all") - F.col("m_before") - F.col("m")) + F.col("m")).alias("in_x"), F.lit(None).cast("long").alias("above_x")))
    two = rows.where(~F.col("wide_y")) if any_y else rows
    out = two.groupBy(*by, "j").applyInArrow(_blocks("i", "py", "a", "py", False, ("in_y", "above_y")), schema(two, "in_y", "above_y"))
    if any_y:
        same = cells.where("wide_y").groupBy(*by, "y", "i").agg(F.sum("m").alias("w"))
        later = Window.partitionBy(*by, "y").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)  # a row a part
        same = same.select(*by, "y", "i", (2 * F.coalesce(F.sum("w").over(later), F.lit(0))).alias("in_y"))
        out = out.unionByName(rows.where("wide_y").join(same.hint("merge"), [*by, "y", "i"]).withColumn("above_y", F.lit(None).cast("long")))

    for s, k, w in (("x", "i", "b"), ("y", "j", "a")):
        later = Window.partitionBy(*by).orderBy(F.desc(k)).rowsBetween(Window.unboundedPreceding, -1)  # up to 2 GRID rows a group
        per = cells.groupBy(*by, k).agg(F.sum(F.col("m") * F.col(w)).alias(f"own_{s}"))
        out = out.join(per.select("*", (2 * F.coalesce(F.sum(f"own_{s}").over(later), F.lit(0))).alias(f"later_{s}")), [*by, k])
        out = out.withColumn(f"above_{s}", F.col(f"later_{s}") + F.coalesce(f"above_{s}", f"own_{s}"))
    grid = cells.groupBy(*by, "i", "j").agg(F.sum("m").alias("w"))
    grid = grid.groupBy(*by).applyInArrow(_beyond, schema(grid, "beyond")).drop("w")
    totals = ranked.groupBy(*by).agg(F.sum(whole("a") * whole("b") * F.col("m").cast("decimal(18,0)")).alias("p"), F.sum((whole("a") - 1) * (whole("b") - 1) * F.col("m").cast("decimal(18,0)")).alias("s"))
    out = out.join(grid.hint("merge"), [*by, "i", "j"]).join(totals, by)
    over = 4 * F.col("beyond") + F.col("in_x") + F.col("in_y")
    left = F.col("p") - whole("a") * whole("b") - (F.col("above_y") - F.col("a")) - (F.col("above_x") - F.col("b")) + (over - 1)
    varies = (F.col("dx") > 1) & (F.col("dy") > 1) & ~((F.col("dx") == 2) & (F.col("nx") == 1)) & ~((F.col("dy") == 2) & (F.col("ny") == 1))
    same = varies & (F.signum(left.cast("double")) == F.signum(F.col("s").cast("double")))
    return out.groupBy(*by).agg((F.sum(F.when(same, F.col("m")).otherwise(0)) / F.sum("m")).alias("stability"))


def direction_stability(both: DataFrame, part: int | None = None) -> DataFrame:
    """(target, feature, stability): see leave_one_out(). Tables of up to `part` rows are done pair by pair in NumPy, larger
    ones by blocks over the cluster; both give the same numbers."""
    ship(both.sparkSession)
    rows = both.select("target", "feature", "x", "y")
    if rows.count() > (part or PART):
        return _left_out(ranked_pairs(rows, ["target", "feature"], part, places=True), ["target", "feature"], part)

    def run(key, rows):
        x, y = (rows[c].to_numpy() for c in ("x", "y"))
        return pa.table({"target": [key[0].as_py()], "feature": [key[1].as_py()], "stability": [leave_one_out(x, y)]})

    return rows.groupBy("target", "feature").applyInArrow(run, "target string, feature string, stability double")


def _patterns(rows: DataFrame, names: list[str]) -> dict[str, tuple]:
    """feature -> what is the same for features that are there on the same rows: their number and sums over their ids."""
    found = unpivot(rows, names, ("_r",)).where("v IS NOT NULL").groupBy("column").agg(F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(k), "_r").cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)])
    return {r["column"]: (r["n"], r["h0"], r["h1"]) for r in found.collect()}  # as many as the protocol has columns


def _products(size: int):
    """Sums of the products of all pairs of places of the vectors of a task, as (i, j, s)."""

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            total += v.T @ v
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    return run


def redundancy(df: DataFrame, row_id: list[str], features: list[str], threshold: float = 0.85, part: int | None = None) -> DataFrame:
    """(a, b, n, rho) for pairs of features whose association is at the threshold or above.

    Features that are there on the same rows are ranked once each, and all their pairs come from one product of the rows'
    vectors of ranks: a row sends one number a feature, a task one number a pair (it holds the features squared). Only pairs
    that are there on different rows are ranked for themselves, on the rows that have both.
    """
    ship(df.sparkSession)
    names = sorted(features)
    rows = materialize(df.select(F.monotonically_increasing_id().alias("_r"), *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in names]), "features")
    pattern = _patterns(rows, names)
    classes: dict[tuple, list[str]] = {}
    for c in names:
        if c in pattern:
            classes.setdefault(pattern[c], []).append(c)
    out = []
    for (n, *_), same in classes.items():
        if len(same) < 2:
            continue
        long = unpivot(rows.where(F.col(f"`{same[0]}`").isNotNull()), same, ("_r",))
        values = materialize(long.groupBy("column", "v").agg(F.count("*").alias("c")), "values")
        rank = (2 * F.col("c_before") + F.col("c") - F.lit(n)).cast("double")
        ranks = ordered(values, ["column"], "v", ["c"], part).select("column", "v", rank.alias("rank"))
        vectors = long.join(ranks.hint("merge"), ["column", "v"]).groupBy("_r").agg(F.array_sort(F.collect_list(F.struct("column", "rank"))).alias("x"))
        sums = materialize(vectors.select(F.col("x.rank").alias("x")).mapInArrow(_products(len(same)), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")), "products")
        norm = lambda k: sums.where("i = j").select(F.col("i").alias(k), F.sqrt("s").alias(f"s{k}"))
        name = F.array(*map(F.lit, same))
        both = sums.where("i < j").join(norm("i"), "i").join(norm("j"), "j").where("si > 0 AND sj > 0")
        out.append(both.select(name[F.col("i")].alias("a"), name[F.col("j")].alias("b"), F.lit(n).cast("long").alias("n"), (F.col("s") / F.col("si") / F.col("sj")).alias("rho")))
    if len(classes) > 1:
        number = {p: k for k, p in enumerate(classes)}
        cells = F.array(*[F.struct(F.lit(c).alias("f"), F.lit(number[pattern[c]]).alias("k"), F.col(f"`{c}`").alias("v")) for c in names if c in pattern])
        there = rows.select(F.filter(cells, lambda s: s["v"].isNotNull()).alias("c"))
        two = there.select(F.explode("c").alias("p"), "c").select("p", F.explode(F.filter("c", lambda s: (s["f"] > F.col("p.f")) & (s["k"] != F.col("p.k")))).alias("q"))
        rho = spearman(two.select(F.col("p.f").alias("left"), F.col("q.f").alias("right"), F.col("p.v").alias("x"), F.col("q.v").alias("y")), ["left", "right"], part)
        out.append(rho.withColumnsRenamed({"left": "a", "right": "b"}))
    links = df.sparkSession.createDataFrame([], "a string, b string, n long, rho double")
    for one in out:
        links = links.unionByName(one)
    return links.where(F.abs("rho") >= threshold)


def representatives(links: DataFrame, ranked: DataFrame) -> dict[str, str]:
    """feature -> the one that stands for it: by falling score each feature is taken unless a taken one is linked to it.

    On the driver: there are as many features as the protocol has columns.
    """
    near: dict[str, set[str]] = {}
    for a, b in links.select("a", "b").collect():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out: dict[str, str] = {}
    taken: list[str] = []
    for f, _ in sorted(ranked.select("feature", "score").collect(), key=lambda r: (-(r[1] or 0.0), r[0])):
        first = next((t for t in taken if t in near.get(f, ())), None)
        out[f] = first or f
        if first is None:
            taken.append(f)
    return out


def ranking(association: DataFrame, stability: DataFrame, weights: tuple[float, float] = (0.7, 0.3), min_abs: float = 0.3, min_stability: float = 0.7) -> DataFrame:
    """(target, feature, n, rho, stability, score, passed, rank): the rank is by score within a target."""
    score = F.abs("rho") * weights[0] + F.col("stability") * weights[1]
    both = association.join(stability, ["target", "feature"]).where("rho IS NOT NULL").withColumn("score", score)
    passed = (F.abs("rho") >= min_abs) & (F.col("stability") >= min_stability)
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.round("score", 9)), "feature"))
    return both.select("target", "feature", "n", "rho", "stability", "score", passed.alias("passed"), rank.alias("rank"))


def across_targets(ranked: DataFrame, n_targets: int, need_all: bool = True, min_consistency: float = 1.0) -> DataFrame:
    """(feature, n_passed, consistency, score, validated): whether a feature holds for all targets in one direction."""
    up = F.avg((F.col("rho") > 0).cast("double"))
    per = ranked.groupBy("feature").agg(F.count(F.when(F.col("passed"), 1)).alias("n_passed"), F.greatest(up, 1.0 - up).alias("consistency"), F.avg("score").alias("score"))
    return per.withColumn("validated", (F.col("n_passed") >= (n_targets if need_all else 1)) & (F.col("consistency") >= min_consistency))


def quality_rules(stats: DataFrame, max_missing: float = 0.5, min_unique: int = 4) -> DataFrame:
    return stats.where((F.col("missing_ratio") <= max_missing) & (F.col("n_unique") >= min_unique))


def leaks(df: DataFrame, catalog: DataFrame, target_columns: list[str], forbidden: dict[str, list[str]] | None = None) -> DataFrame:
    """(target, feature, why): features that give a target away - from its own operation, equal to it on every row, or
    forbidden by name."""
    entries = [r.asDict() for r in catalog.collect()]  # as many as the protocol has columns
    of = {e["column"]: e for e in entries}
    numbers = {c for c, kind in df.dtypes if kind == "double"}
    found: list[tuple[str, str, str]] = [(t, f, "forbidden") for t, fs in (forbidden or {}).items() for f in fs]
    asked = []
    for t in target_columns:
        for e in entries:
            c = e["column"]
            if e["role"] in ("target", "meta", "qc") or c not in numbers or c == t:
                continue
            if of.get(t, {}).get("operation_id") and of[t]["operation_id"] == e.get("operation_id"):
                found.append((t, c, "same_operation"))
            same = F.col(f"`{t}`").eqNullSafe(F.col(f"`{c}`").cast("double"))
            asked.append((t, c, F.min(same.cast("int"))))
    if asked:
        got = df.agg(*[x.alias(f"x{k}") for k, (_, _, x) in enumerate(asked)]).first()
        found += [(t, c, "equal") for k, (t, c, _) in enumerate(asked) if got[f"x{k}"] == 1]
    return df.sparkSession.createDataFrame(found, "target string, feature string, why string")
