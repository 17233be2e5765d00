"""Recordings that are too long for one task: samples in chunks, filtered and searched for peaks side by side.

A chunk gets `HALO_SEC` of its neighbours on both sides. The filter's response has fallen below rounding by then (its slowest
pole halves six times a second), so the inner samples are those of the whole recording. A steep region belongs to the chunk
in which it starts, and is seen to its end in the halo; what depends on all regions of a recording (their mean length,
the distance of peaks) is settled afterwards on one narrow row a beat. The result is that of record.detected() on the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.ship import ship
from sigloom.signal import peaks
from sigloom.signal.filters import bandpass
from sigloom.signal.record import HRV_BAND

HALO_SEC = 20.0
CHUNK = 1 << 16
_PIECE = "path string, block long, nth long, x array<double>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits, in order, to arrays of samples: a run of lines of one split in a batch is a piece."""
    now, nth = None, 0
    for batch in batches:
        path, block = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        lines = batch.column(2).to_pylist()
        edges = [0, *[k for k in range(1, len(lines)) if (path[k], block[k]) != (path[k - 1], block[k - 1])], len(lines)]
        out = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            nth = nth + 1 if (path[lo], block[lo]) == now else 0
            now = path[lo], block[lo]
            x = [_sample(t) for t in lines[lo:hi] if t.strip("﻿ \t\r")]
            if x:
                out.append((path[lo], int(block[lo]), nth, x))
        if out:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["path", "block", "nth", "x"])


def _sample(line: str) -> float:
    try:
        return float(line.strip("﻿").replace(";", ",").split(",")[0])
    except ValueError:
        return np.nan


def read_long_signals(spark: SparkSession, root: str, chunk: int = CHUNK) -> DataFrame:
    """(path, chunk, x): the first column of the CSV files under root, split by Spark, in chunks of equal size.

    A file with a line that is no number is no signal and gives no row.
    """
    ship(spark)
    text = spark.read.option("recursiveFileLookup", True).text(root)
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    pieces = lines.mapInArrow(_pieces, _PIECE)
    bad = F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    sizes = pieces.select("path", "block", "nth", F.size("x").cast("long").alias("n"), bad.alias("bad"))  # a row a piece
    before = Window.partitionBy("path").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.select("path", "block", "nth", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), F.max("bad").over(Window.partitionBy("path")).alias("bad")).where(~F.col("bad"))
    placed = pieces.join(at, ["path", "block", "nth"])
    first, last = F.floor(F.col("at") / chunk), F.floor((F.col("at") + F.size("x") - 1) / chunk)
    cut = placed.select("path", "at", "x", F.explode(F.sequence(first, last)).alias("chunk"))
    lo = F.greatest(F.lit(0), F.col("chunk") * chunk - F.col("at"))
    hi = F.least(F.size("x").cast("long"), (F.col("chunk") + 1) * chunk - F.col("at"))
    parts = cut.select("path", "chunk", F.struct((F.col("at") + lo).alias("at"), F.slice("x", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("x")).alias("p"))
    return parts.groupBy("path", "chunk").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["x"])).alias("x"))


def with_halo(chunks: DataFrame, keys: list[str], halo: int) -> DataFrame:
    """chunks (keys, chunk: 0, 1, ..., x) with at, the place of its first sample, n, the samples of the recording, and what
    is beside it: left and right. Samples are shuffled once, by chunk."""
    n = F.size("x").cast("long")
    sizes = chunks.select(*keys, "chunk", n.alias("n"))
    mine = Window.partitionBy(*keys)
    before = mine.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), F.sum("n").over(mine).alias("n"))
    tail = F.slice("x", F.greatest(F.lit(1), F.size("x") - halo + 1), F.lit(halo))
    sent = F.array(
        F.struct(F.col("chunk").alias("chunk"), F.lit(0).alias("side"), F.col("x").alias("x")), F.struct((F.col("chunk") + 1).alias("chunk"), F.lit(-1).alias("side"), tail.alias("x")),
        F.struct((F.col("chunk") - 1).alias("chunk"), F.lit(1).alias("side"), F.slice("x", 1, halo).alias("x")),
    )
    side = lambda s: F.first(F.when(F.col("side") == s, F.col("x")), ignorenulls=True)
    met = chunks.select(*keys, F.inline(sent)).groupBy(*keys, "chunk").agg(side(0).alias("x"), side(-1).alias("left"), side(1).alias("right"))
    return met.where("x IS NOT NULL").join(sizes, [*keys, "chunk"])


def _regions(fs: float, band: tuple[float, float]) -> Column:
    @F.pandas_udf("array<struct<start:bigint,stop:bigint,peak:bigint>>")
    def run(left: pd.Series, own: pd.Series, right: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for before, x, after, first in zip(left, own, right, at, strict=True):
            parts = [np.asarray(p if p is not None else [], float) for p in (before, x, after)]
            y = bandpass(np.concatenate(parts), fs, *band)
            lo, hi = len(parts[0]), len(parts[0]) + len(parts[1])
            if len(y) < 2:
                out.append([])
                continue
            starts, ends = peaks.steep_regions(y, fs)
            shift = int(first) - lo
            out.append([{"start": int(s) + shift, "stop": int(e) + shift, "peak": peaks.peak_in(y, s, e, fs) + shift} for s, e in zip(starts, ends, strict=True) if lo <= s < hi])
        return pd.Series(out)

    return run("left", "x", "right", "at")


def apart(found: DataFrame, keys: list[str], least: float) -> DataFrame:
    """The peaks without those that follow the last one kept by `least` samples or fewer.

    Only runs of peaks that are each that close to the one before have to be looked at in order; they are short.
    """
    w = Window.partitionBy(*keys).orderBy("peak")
    new = F.coalesce(F.col("peak") - F.lag("peak").over(w) > least, F.lit(True)).cast("long")
    runs = found.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    empty = F.array().cast("array<bigint>")
    keep = lambda a, p: F.when((F.size(a) == 0) | (p - F.element_at(a, -1) > least), F.concat(a, F.array(p))).otherwise(a)
    kept = runs.groupBy(*keys, "run").agg(F.aggregate(F.sort_array(F.collect_list("peak")), empty, keep).alias("p"))
    return kept.select(*keys, F.explode("p").alias("peak"))


def long_peaks(chunks: DataFrame, keys: list[str], fs: float, band: tuple[float, float] = HRV_BAND, halo_sec: float = HALO_SEC) -> DataFrame:
    """chunks (keys, chunk, x) of recordings -> (keys, peak): the R peaks of each recording, as places of samples.

    Chunks are numbered from 0 and, but for a recording's last, hold at least halo_sec.
    """
    ship(chunks.sparkSession)
    halo = int(np.ceil(halo_sec * fs))
    met = with_halo(chunks, keys, halo).where(F.col("n") >= int(fs * peaks.LONG_SEC) + 2)
    found = met.select(*keys, F.explode(_regions(fs, band)).alias("r")).select(*keys, "r.*")
    size = F.col("stop") - F.col("start")
    mean = found.groupBy(*keys).agg(F.avg(size).alias("_mean"))
    large = found.join(mean, keys).where(size >= peaks.LEAST_SHARE * F.col("_mean"))
    return apart(large.select(*keys, "peak"), keys, peaks.DELAY_SEC * fs)
