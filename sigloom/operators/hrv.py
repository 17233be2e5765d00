"""Heart-rate variability from beats as window functions and aggregates: beats of all records at once, no Python.

Beats are rows (keys, order, rr); rr is the seconds since the beat before, NULL for the first beat of a record.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(beats: DataFrame, keys: list[str], time: str, order: list[str] | None = None) -> DataFrame:
    """beats with rr, the seconds since the one before, from a column of seconds."""
    w = Window.partitionBy(*keys).orderBy(*(order or [time]))
    return beats.withColumn("rr", F.col(time) - F.lag(time).over(w))


def _differences(rr: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The intervals in ms with d, the change from the interval before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ms = rr.where("rr IS NOT NULL").withColumn("ms", F.col("rr") * 1000.0)
    return ms.withColumn("d", F.col("ms") - F.lag("ms").over(w))


def time_domain(rr: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The 15 time-domain features of each record; with fewer than three intervals all but n_rr are NULL."""
    hr = F.try_divide(F.lit(60.0), F.col("rr"))
    size = F.abs("d")
    found = {
        "MeanNN_ms": F.avg("ms"),
        "MedianNN_ms": F.percentile("ms", 0.5),
        "SDNN_ms": F.stddev_samp("ms"),
        "RMSSD_ms": F.sqrt(F.avg(F.col("d") * F.col("d"))),
        "SDSD_ms": F.stddev_samp("d"),
        "NN_min_ms": F.min("ms"),
        "NN_max_ms": F.max("ms"),
        "NN_range_ms": F.max("ms") - F.min("ms"),
        "pNN20_percent": F.avg((size > 20.0).cast("double")) * 100.0,  # a NULL change is not counted
        "pNN50_percent": F.avg((size > 50.0).cast("double")) * 100.0,
        "MeanHR_bpm": F.avg(hr),
        "HR_min_bpm": F.min(hr),
        "HR_max_bpm": F.max(hr),
        "HR_std_bpm": F.stddev_samp(hr),
    }
    per = _differences(rr, keys, order).groupBy(*keys).agg(F.count("*").alias("n_rr"), *[c.alias(n) for n, c in found.items()])
    return per.select(*keys, "n_rr", *[F.when(F.col("n_rr") >= 3, F.col(n)).alias(n) for n in found])


def poincare(rr: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SD1, SD2, their ratio and the area of the ellipse."""
    per = _differences(rr, keys, order).groupBy(*keys).agg(F.count("*").alias("n"), F.var_samp("ms").alias("vr"), F.var_samp("d").alias("vd"))
    per = per.withColumn("a", 2.0 * F.col("vr") - 0.5 * F.col("vd"))
    per = per.withColumn("a", F.when((F.col("a") < 0) & (F.col("a") > -1e-9), 0.0).otherwise(F.col("a")))
    ok = F.col("n") >= 3
    sd1, sd2 = F.when(ok, F.sqrt(F.col("vd") / 2.0)), F.when(ok & (F.col("a") >= 0), F.sqrt("a"))
    per = per.select(*keys, sd1.alias("SD1_ms"), sd2.alias("SD2_ms"))
    return per.select("*", F.when(F.col("SD2_ms") > 1e-12, F.col("SD1_ms") / F.col("SD2_ms")).alias("SD1_SD2_ratio"), (math.pi * F.col("SD1_ms") * F.col("SD2_ms")).alias("Ellipse_area"))


def shannon_entropy(rr: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Entropy of the histogram of the intervals over equal bins from the least to the greatest."""
    ms = rr.where("rr IS NOT NULL").select(*keys, (F.col("rr") * 1000.0).alias("ms"))
    w = Window.partitionBy(*keys)
    lo, hi = F.min("ms").over(w), F.max("ms").over(w)
    place = F.coalesce(F.floor(F.try_divide((F.col("ms") - lo) * float(bins), hi - lo)), F.lit(bins // 2))
    seen = ms.select(*keys, F.least(place, F.lit(bins - 1)).alias("bin"), F.count("*").over(w).alias("n"))
    per = seen.groupBy(*keys, "bin").agg((F.count("*") / F.first("n")).alias("p"), F.first("n").alias("n"))
    return per.groupBy(*keys).agg(F.when(F.first("n") >= 3, F.abs(F.sum(F.col("p") * F.ln("p")))).alias("ShannonEntropy"))


def _series(rr: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, x): the intervals of a record in ms as an array. A record is bounded by its recording time."""
    row = F.struct(*order, (F.col("rr") * 1000.0).alias("ms"))
    per = rr.where("rr IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return per.select(*keys, F.transform("r", lambda s: s["ms"]).alias("x"))


def nonlinear(rr: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """ApproxEntropy, SampleEntropy, DFA_alpha1, DFA_alpha2 and FractalDimension: arrays in Arrow batches through NumPy."""
    from sigloom.ship import ship
    from sigloom.signal import hrv as h

    ship(rr.sparkSession)
    names = ["ApproxEntropy", "SampleEntropy", "DFA_alpha1", "DFA_alpha2", "FractalDimension"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(series):
        import numpy as np
        import pandas as pd

        rows = []
        for x in series:
            x = np.asarray(x, dtype=float)
            a1, a2 = h.dfa(x / 1000.0)
            rows.append([h.approximate_entropy(x), h.sample_entropy(x), a1, a2, h.higuchi_dimension(x)])
        return pd.DataFrame(rows, columns=names, dtype="float64")

    out = _series(rr, keys, order).select(*keys, run("x").alias("f"))
    return out.select(*keys, *[F.nanvl(F.col(f"f.{n}"), F.lit(None).cast("double")).alias(n) for n in names])


# ---------------------------------------------------------------- beats as rows of samples


def median_wave(samples: DataFrame, keys: list[str], pos: str = "pos", x: str = "x") -> DataFrame:
    """The median of the beats at each position: (keys, pos, m)."""
    return samples.groupBy(*keys, pos).agg(F.percentile(x, 0.5).alias("m"))


def template_correlation(samples: DataFrame, keys: list[str], beat: str, pos: str = "pos", x: str = "x", threshold: float = 0.8) -> DataFrame:
    """(keys, beat, r, good): each beat, standardised, against the median of all at each position."""
    w = Window.partitionBy(*keys, beat)
    sd = F.stddev_pop(x).over(w)
    z = samples.withColumn("z", F.when(sd > 1e-9, (F.col(x) - F.avg(x).over(w)) / sd).otherwise(0.0))
    template = median_wave(z, keys, pos, "z")
    both = z.join(template, [*keys, pos])
    per = both.groupBy(*keys, beat).agg(F.nanvl(F.corr("z", "m"), F.lit(None).cast("double")).alias("r"))
    return per.withColumn("good", F.coalesce(F.col("r") >= threshold, F.lit(False)))


def area_over_chord(x: Column, fs: float) -> Column:
    """The trapezoid area of an array above the line between its ends."""
    n = F.size(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    ends = x[0] + F.element_at(x, -1)
    return F.when(n >= 2, (total - ends / 2.0 - (n - 1) * ends / 2.0) / float(fs))


def width_at_fraction(x: Column, peak: Column, fs: float, fraction: float = 0.5) -> Column:
    """Milliseconds between the first samples on both sides of a peak that are not above a fraction of it."""
    bound = F.abs(F.get(x, peak)) * float(fraction)
    low = F.transform(x, lambda v, i: F.when(F.abs(v) <= bound, i))
    left = F.coalesce(F.array_max(F.filter(low, lambda i: i < peak)), F.lit(0))
    right = F.coalesce(F.array_min(F.filter(low, lambda i: i > peak)), F.size(x) - 1)
    return F.when(bound > 1e-12 * fraction, (right - left) / float(fs) * 1000.0)
