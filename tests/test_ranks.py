"""Ranks, quantiles, stability and redundancy: many parts against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import analysis, ranks, reports


def mean_ranks(x):
    _, place, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2.0)[place]


def plain_rho(x, y):
    a, b = mean_ranks(x), mean_ranks(y)
    return float(np.corrcoef(a, b)[0, 1]) if a.std() and b.std() else None


def plain_left_out(x, y):
    n = len(x)
    if n < 2 or len(set(x)) < 2 or len(set(y)) < 2:
        return 0.0
    sign = np.sign(((mean_ranks(x) - (n + 1) / 2) * (mean_ranks(y) - (n + 1) / 2)).sum())
    same = 0
    for k in range(n):
        a, b = np.delete(x, k), np.delete(y, k)
        if len(set(a)) > 1 and len(set(b)) > 1:
            same += np.sign(((mean_ranks(a) - n / 2) * (mean_ranks(b) - n / 2)).sum()) == sign
    return same / n


def groups(seed=1):
    rng = np.random.default_rng(seed)
    out = {}
    for k, n in enumerate((1, 2, 3, 5, 8, 40, 90, 400)):
        for kind in range(4):
            x = rng.integers(0, 3, n).astype(float) if kind == 0 else rng.normal(size=n).round(1) if kind == 1 else np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n)) if kind == 2 else np.full(n, 2.0)
            y = rng.integers(0, 2, n).astype(float) if kind == 0 else (x + rng.normal(size=n)).round(1)
            out[f"t{k}", f"f{kind}"] = x, y
    return out


@pytest.fixture(scope="module")
def both(spark):
    rows = [(t, f, float(a), float(b)) for (t, f), (x, y) in groups().items() for a, b in zip(x, y, strict=True)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "target string, feature string, x double, y double")


@pytest.mark.parametrize("part", [None, 7])
def test_spearman_by_parts(both, part, monkeypatch):
    monkeypatch.setattr(ranks, "CUTS", 5)
    got = {(r.target, r.feature): (r.n, r.rho) for r in analysis.spearman(both, part=part).collect()}
    for key, (x, y) in groups().items():
        rho = plain_rho(x, y)
        assert got[key][0] == len(x) and (got[key][1] is None) == (rho is None)
        assert rho is None or abs(got[key][1] - rho) < 1e-9


@pytest.mark.parametrize("part", [None, 7])
def test_stability_by_parts(both, part, monkeypatch):
    monkeypatch.setattr(ranks, "CUTS", 5)
    got = {(r.target, r.feature): r.stability for r in analysis.direction_stability(both, part=part).collect()}
    for key, (x, y) in groups().items():
        assert got[key] == pytest.approx(plain_left_out(x, y), abs=1e-12), key


def test_no_task_orders_a_group(spark, monkeypatch):
    """Running sums of one large group: the parts are many, and none holds a large share."""
    values = spark.range(20000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 20011).cast("double").alias("v"), F.lit(1).cast("long").alias("c"))
    out = ranks.ordered(values, ["g"], "v", ["c"], part=1000)
    assert out.where("c_all <> 20000").count() == 0
    assert [r.c_before for r in out.orderBy("v").collect()] == list(range(20000))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan and "windowspecdefinition(g#" not in plan.replace("windowspecdefinition(g#", "windowspecdefinition(g#", 1).split("_part", 1)[0]


@pytest.mark.parametrize("small", [50_000, 0])
def test_quantiles_are_those_of_all_values(spark, small, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", small)
    rng = np.random.default_rng(3)
    data = {"wide": rng.normal(size=60_000), "ties": rng.integers(0, 4, 60_000).astype(float), "hot": np.where(rng.random(60_000) < 0.4, 1.5, rng.normal(size=60_000)), "one": np.array([4.0])}
    if small:
        data |= {f"n{n}": rng.normal(size=n) for n in (2, 3, 4, 5, 101, 102, 9999)}
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [("wide", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    asked = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: r.q for r in ranks.exact_quantiles(df, ["g"], "v", asked).collect()}
    assert set(got) == set(data)
    for k, x in data.items():
        assert got[k] == pytest.approx(np.quantile(x, asked).tolist(), abs=1e-12), k


def test_summaries_of_columns_with_gaps(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, None), (4.0, None, 5.0), (None, None, 5.0)], "a double, b double, c double")
    got = {r["column"]: r for r in reports.summarize(df, ["a", "b", "c"]).collect()}
    assert (got["a"].median, got["a"].iqr, got["a"].n_unique, got["a"].n_missing) == (2.0, 1.5, 3, 1)
    assert got["b"].median is None and got["b"].n_valid == 0 and got["b"].n_unique == 0
    assert (got["c"].median, got["c"].iqr, got["c"].n_unique) == (5.0, 0.0, 1)


@pytest.mark.parametrize("part", [None, 20])
def test_redundancy_with_other_gaps(spark, part):
    rng = np.random.default_rng(5)
    n = 80
    base = rng.normal(size=n)
    cols = {f"f{k}": (base + rng.normal(size=n) * (0.2 + k)).round(1) for k in range(5)} | {"same": np.full(n, 1.0)}
    for k, c in enumerate(("f1", "f3")):
        cols[c] = np.where(rng.random(n) < 0.2 + 0.1 * k, np.nan, cols[c])
    cols["f4"] = np.where(np.isnan(cols["f3"]), np.nan, cols["f4"])  # f3 and f4 have the same gaps
    cols["gone"] = np.full(n, np.nan)
    names = list(cols)
    rows = [tuple(None if np.isnan(cols[c][i]) else float(cols[c][i]) for c in names) for i in range(n)]
    df = spark.createDataFrame(rows + rows[:5], ", ".join(f"{c} double" for c in names))  # repeated rows count
    got = {(r.a, r.b): (r.n, r.rho) for r in analysis.redundancy(df, [], names, 0.0, part).collect()}
    want = {}
    for i, a in enumerate(sorted(names)):
        for b in sorted(names)[i + 1 :]:
            x, y = (np.r_[cols[c], cols[c][:5]] for c in (a, b))
            ok = ~np.isnan(x) & ~np.isnan(y)
            rho = plain_rho(x[ok], y[ok]) if ok.any() else None
            if rho is not None:
                want[a, b] = int(ok.sum()), rho
    assert set(got) == set(want)
    assert all(got[k][0] == n and abs(got[k][1] - rho) < 1e-9 for k, (n, rho) in want.items())
