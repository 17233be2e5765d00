"""Recordings in chunks against the same recordings whole; entropies by trees against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import hrv as rows
from sigloom.operators import long_records
from sigloom.signal import hrv, peaks, record, synthetic

FS = 234.45


@pytest.fixture(scope="module")
def signals():
    out = {f"r{k}": synthetic.recording(sec, k, **how)[0] for k, (sec, how) in enumerate([(400, {}), (333, {"noise": 8.0}), (250, {"wander": 40.0, "hr": 110.0}), (61, {"inverted": True}), (0.5, {}), (21, {})])}
    jumpy = out["r0"].copy()
    jumpy[30_000:] += 200.0  # a step at a seam
    return {k: np.asarray(x, float) for k, x in (out | {"jump": jumpy, "flat": np.zeros(20_000)}).items()}


def chunked(spark, signals, size):
    data = [(k, c, x[c * size : (c + 1) * size].tolist()) for k, x in signals.items() for c in range(-(-len(x) // size))]
    return spark.createDataFrame(data, "id string, chunk long, x array<double>").repartition(6)


@pytest.mark.parametrize("size", [6000, 15_000, 1_000_000])
def test_peaks_are_those_of_the_whole(spark, signals, size):
    got = {}
    for r in long_records.long_peaks(chunked(spark, signals, size), ["id"], FS).collect():
        got.setdefault(r.id, []).append(r.peak)
    for k, x in signals.items():
        assert sorted(got.get(k, [])) == record.detected(x, FS)[1].tolist(), k


def test_halo_is_wide_enough():
    """Filtered samples of a chunk are those of the whole recording, to rounding."""
    from sigloom.signal.filters import bandpass

    x = np.asarray(synthetic.recording(300, 3, wander=40.0)[0], float) + np.linspace(0, 500, int(300 * FS))
    halo = int(np.ceil(long_records.HALO_SEC * FS))
    whole, part = bandpass(x, FS, *record.HRV_BAND), bandpass(x[20_000 - halo : 30_000 + halo], FS, *record.HRV_BAND)
    assert np.abs(part[halo:-halo] - whole[20_000:30_000]).max() < 1e-9


def test_close_peaks_go_as_in_order(spark):
    rng = np.random.default_rng(2)
    at = {k: np.unique(rng.integers(0, 3000, 400)) for k in ("a", "b")}
    got = long_records.apart(spark.createDataFrame([(k, int(p)) for k, x in at.items() for p in x], "id string, peak long"), ["id"], 9.5).collect()
    for k, x in at.items():
        want, last = [], -np.inf
        for p in x:
            if p - last > 9.5:
                want.append(p)
                last = p
        assert sorted(r.peak for r in got if r.id == k) == want


def test_files_are_read_in_order(spark, tmp_path, signals):
    home = tmp_path / "01.01.2026" / "before"
    home.mkdir(parents=True)
    for k in ("r1", "r3"):
        (home / f"{k}.csv").write_text("﻿" + "\n".join(f"{v!r};x" for v in signals[k].tolist()) + "\n\n")
    (home / "bad.csv").write_text("1\n2\nthree\n4\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")  # many splits a file
    try:
        chunks = long_records.read_long_signals(spark, str(tmp_path), 6000)
        found = {r.path.rsplit("/", 1)[1]: r for r in chunks.groupBy("path").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "x"))), lambda c: c["x"])).alias("x"), F.count("*").alias("n")).collect()}
        assert set(found) == {"r1.csv", "r3.csv"}
        for k in ("r1", "r3"):
            assert found[f"{k}.csv"].x == signals[k].tolist() and found[f"{k}.csv"].n == -(-len(signals[k]) // 6000)
        at = long_records.long_peaks(chunks, ["path"], FS)
        beats = rows.intervals(at.withColumn("t", F.col("peak") / FS), ["path"], "t")
        per = {r.path.rsplit("/", 1)[1]: r for r in rows.time_domain(beats, ["path"], ["t"]).collect()}
        want = hrv.time_domain(np.diff(record.detected(signals["r1"], FS)[1]) / FS)
        assert per["r1.csv"].MeanNN_ms == pytest.approx(want["MeanNN_ms"]) and per["r1.csv"].RMSSD_ms == pytest.approx(want["RMSSD_ms"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_neighbours_by_trees():
    rng = np.random.default_rng(1)
    for n in (1500, 3300):
        for x in (rng.normal(size=n), rng.integers(0, 5, n).astype(float), np.round(np.cumsum(rng.normal(size=n)), 1), np.full(n, 2.0)):
            for m in (1, 2, 3):
                t = np.lib.stride_tricks.sliding_window_view(x, m)
                for r in (0.0, 0.2 * x.std()):
                    assert (hrv.Boxes(t).counts(r)[: len(t)] == hrv._counted(t, r)).all()


def test_entropies_of_long_series_take_fewer_steps():
    """Ten times the beats take far less than a hundred times the comparisons."""
    import time

    rng = np.random.default_rng(3)
    took = []
    for n in (4000, 40_000):
        x = np.round(800 + 50 * np.convolve(rng.normal(size=n), np.ones(5) / 5, "same"), 1)
        began = time.process_time()
        assert 1 < hrv.sample_entropy(x) < 2.5 and 1 < hrv.approximate_entropy(x) < 2.5
        took.append(time.process_time() - began)
    assert took[1] < 50 * took[0]


def test_regions_are_shared_code(signals):
    """detect_r_peaks() is made of the parts that chunks use."""
    x = record.detected(signals["r0"], FS)[0]
    s, e = peaks.steep_regions(x, FS)
    assert len(s) == len(e) and set(peaks.detect_r_peaks(x, FS).tolist()) <= {peaks.peak_in(x, a, b, FS) for a, b in zip(s, e, strict=True)}


def test_query_of_long_recordings(spark, data):
    """The registered query against whole signals."""
    from sigloom import queries

    got: dict = {}
    for r in queries.long_recording_peaks(spark, data).collect():
        got.setdefault(r.label, []).append(r.peak)
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("label", "vec_id").collect()
    for label in {r.label for r in rows}:
        x = np.concatenate([np.asarray(r.embedding, float) for r in rows if r.label == label])
        assert sorted(got.get(label, [])) == record.detected(x, queries.FS)[1].tolist()
