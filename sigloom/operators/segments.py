"""Segments of records: whole, windows of fixed length, named parts. Generated per row and exploded, without a join."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KIND = "array<struct<label:string,start_sec:double,end_sec:double,window_idx:int>>"


def _segment(label: Column, start: Column, end: Column, idx: Column) -> Column:
    return F.struct(label.alias("label"), start.cast("double").alias("start_sec"), end.cast("double").alias("end_sec"), idx.cast("int").alias("window_idx"))


def full(total: Column) -> Column:
    return F.array(_segment(F.lit("full"), F.lit(0.0), total, F.lit(None)))


def fixed_windows(total: Column, window_sec: float, step_sec: float | None = None, min_window_sec: float = 0.0, drop_last_short: bool = True) -> Column:
    """Windows from 0 in steps; the last are cut at the end, and dropped from the first that is too short."""
    step = float(step_sec or window_sec)
    if step <= 0 or window_sec <= 0:
        raise ValueError("window and step must be above 0")
    count = F.greatest(F.ceil(total / step), F.lit(0)).cast("int")
    starts = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), F.lit(1), count), lambda i: i * step)
    made = F.transform(starts, lambda s, i: _segment(F.lit("window"), s, F.least(s + float(window_sec), total), i + 1))
    if drop_last_short:
        return F.filter(made, lambda w: w.end_sec - w.start_sec >= min_window_sec)  # lengths never grow, so none comes after the first short one
    return F.filter(made, lambda w: w.end_sec > w.start_sec)


def named(total: Column, parts: list[Mapping[str, Any]]) -> Column:
    """Parts by seconds from the start, or the last seconds (relative_to: end). Empty parts are dropped."""
    made = []
    for part in parts:
        if part.get("relative_to") == "end":
            start, end = F.greatest(total - float(part["duration_sec"]), F.lit(0.0)), total
        elif "relative_to" in part:
            raise ValueError(f"relative_to can only be end, not {part['relative_to']}")
        else:
            end = part.get("end_sec", "full")
            start, end = F.lit(float(part.get("start_sec", 0.0))), total if end == "full" else F.least(F.lit(float(end)), total)
        made.append(_segment(F.lit(part["label"]), start, end, F.lit(None)))
    return F.filter(F.array(*made), lambda s: s.end_sec > s.start_sec)


def segments(total: Column, profile: Mapping[str, Any]) -> Column:
    """The array of segments of a record of `total` seconds under a segmentation profile."""
    mode = profile["mode"]
    if mode == "full":
        return full(total)
    if mode == "fixed_windows":
        return fixed_windows(total, profile["window_sec"], profile.get("step_sec"), profile.get("min_window_sec", 0.0), profile.get("drop_last_short_window", True))
    if mode == "named_subsegments":
        return named(total, profile["segments"])
    raise ValueError(f"unknown mode of segmentation: {mode}")


def explode_segments(records: DataFrame, profile: Mapping[str, Any], seconds: str = "duration_sec") -> DataFrame:
    """One row per segment, with label, start_sec, end_sec and window_idx."""
    return records.select("*", F.inline(segments(F.col(seconds), profile)))


def cut(signal: Column, fs: Column, start_sec: Column, end_sec: Column) -> Column:
    """The samples [round(start * fs), round(end * fs)) of an array, halves rounded to even."""
    lo, hi = F.rint(start_sec * fs).cast("int"), F.rint(end_sec * fs).cast("int")
    return F.slice(signal, lo + 1, F.greatest(F.least(hi, F.size(signal)) - lo, F.lit(0)))


def rebased_peaks(peaks: Column, fs: Column, start_sec: Column, end_sec: Column) -> Column:
    """The peaks inside a segment, counted from its start."""
    lo, hi = F.rint(start_sec * fs).cast("int"), F.rint(end_sec * fs).cast("int")
    return F.transform(F.filter(peaks, lambda p: (p >= lo) & (p < hi)), lambda p: p - lo)


def without_edge(peaks: Column, samples: Column, fs: Column, guard_sec: float = 0.5) -> Column:
    guard = F.rint(fs * guard_sec).cast("int")
    return F.filter(peaks, lambda p: (p >= guard) & (p < samples - guard))


def long_enough(samples: Column, fs: Column) -> Column:
    """A segment has at least 10 samples and 2 seconds."""
    return samples >= F.greatest(F.lit(10), F.floor(fs * 2.0))


# pure edits of peaks, as a reviewer makes them


def remove_peaks(peaks: Column, gone: Column) -> Column:
    return F.array_except(peaks, gone)


def _extremum(signal: Column, at: Column, radius: int) -> Column:
    """The sample furthest from the median within radius of a sample."""
    lo = F.greatest(at - radius, F.lit(0))
    part = F.slice(signal, lo + 1, F.least(at + radius + 1, F.size(signal)) - lo)
    ordered = F.array_sort(part)
    n = F.size(part)
    mid = (F.element_at(ordered, ((n + 1) / 2).cast("int")) + F.element_at(ordered, ((n + 2) / 2).cast("int"))) / 2
    away = F.transform(part, lambda x: F.abs(x - mid))
    return (lo + F.array_position(away, F.array_max(away)) - 1).cast("int")


def add_peak(signal: Column, peaks: Column, at: Column, radius: int = 10) -> Column:
    at = F.greatest(F.least(at, F.size(signal) - 1), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(peaks, F.array(_extremum(signal, at, radius)))))


def snap_peak(signal: Column, peaks: Column, peak: Column, radius: int = 10) -> Column:
    return F.array_sort(F.array_distinct(F.transform(peaks, lambda p: F.when(p == peak, _extremum(signal, p, radius)).otherwise(p))))
