"""Quality flags, gates and checks as expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.scalars import is_false

#: The flags that are asked for a feature, in order, by the start of its name.
FLAGS = {
    "morph_": ("morphology_validated", "morphology_qc_passed", "morphology_valid", "morph_valid", "valid_morphology", "is_morphology_valid"),
    "hrv_": ("hrv_validated", "hrv_qc_passed", "hrv_valid", "signal_valid", "valid_hrv", "is_hrv_valid", "is_signal_valid"),
    "": ("valid", "signal_valid", "hrv_valid", "morphology_valid"),
}
#: Bounds of the gates.
SIGNAL_LIMITS = {
    "rr_min_sec": 0.3, "rr_max_sec": 2.0, "bad_rr_fraction_max": 0.10, "suspicious_peak_fraction_max": 0.15, "min_rpeaks": 3, "edge_guard_sec": 0.5,
    "local_rr_ratio_low": 0.70, "local_rr_ratio_high": 1.50, "rpeak_amp_ratio_low": 0.40, "rpeak_amp_ratio_high": 2.50, "rpeak_amp_bad_ratio_max": 0.15, "rpeak_amp_median_min": None,
}
MORPHOLOGY_LIMITS = {
    "min_beats_extracted": 3, "min_beats_good": 3, "good_beats_ratio_min": 0.40, "corr_median_min": 0.70, "corr_min_min": None, "require_qrs": True, "qrs_duration_min_ms": 20.0, "qrs_duration_max_ms": 180.0,
    "require_p": False, "require_t": False,
}


def flag_columns(feature: str, columns: list[str]) -> list[str]:
    start = next(s for s in FLAGS if feature.startswith(s))
    return [c for c in FLAGS[start] if c in columns]


def flag_reason(columns: list[str], blind: tuple[str, ...] = ()) -> Callable[[str, Column], Column]:
    """(feature, row as a struct) -> '<flag>=false' for the first flag that says no, else ''.

    blind: flags that are not looked at. A column of plain booleans without gaps went unnoticed in the original pandas
    code; name such columns here to get its reasons.
    """

    def reason(feature: str, row: Column) -> Column:
        asked = [F.when(is_false(row[c]), F.lit(f"{c}=false")) for c in flag_columns(feature, columns) if c not in blind]
        return F.coalesce(*asked, F.lit(""))

    return reason


def _reasons(*asked: tuple[Column, Column]) -> Column:
    """The texts whose condition holds, as an array."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), text) for bad, text in asked]))


def _text(name: str, value: Column, sign: str, bound: float) -> Column:
    return F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("nan")), F.lit(f" {sign} {bound}"))


def signal_gate(limits: Mapping[str, Any] | None = None) -> Column:
    """Reasons against using a record for intervals, over the columns n_rpeaks, rr_phys_bad_ratio, suspicious_ratio,
    rpeak_amp_bad_ratio and rpeak_amp_median. No reason: the record passes."""
    p = SIGNAL_LIMITS | dict(limits or {})
    c = F.col
    asked = [
        (c("rr_phys_bad_ratio") > p["bad_rr_fraction_max"], _text("bad_rr_fraction", c("rr_phys_bad_ratio"), ">", p["bad_rr_fraction_max"])),
        (c("suspicious_ratio") > p["suspicious_peak_fraction_max"], _text("suspicious_peak_fraction", c("suspicious_ratio"), ">", p["suspicious_peak_fraction_max"])),
        (c("n_rpeaks") < p["min_rpeaks"], _text("n_rpeaks", c("n_rpeaks"), "<", p["min_rpeaks"])),
        (c("rpeak_amp_bad_ratio") > p["rpeak_amp_bad_ratio_max"], _text("rpeak_amp_bad_ratio", c("rpeak_amp_bad_ratio"), ">", p["rpeak_amp_bad_ratio_max"])),
    ]
    if p["rpeak_amp_median_min"] is not None:
        low = p["rpeak_amp_median_min"]
        asked.append((c("rpeak_amp_median").isNull() | (c("rpeak_amp_median") < low), _text("rpeak_amp_median", c("rpeak_amp_median"), "<", low)))
    return _reasons(*asked)


def morphology_gate(limits: Mapping[str, Any] | None = None) -> Column:
    """Reasons against using the shape of a record's beats, over n_beats_extracted, n_beats_good, corr_median, corr_min,
    QRS_main_idx, QRS_duration_ms, P_present, T_present and morphology_error."""
    p = MORPHOLOGY_LIMITS | dict(limits or {})
    c = F.col
    share = F.try_divide(c("n_beats_good").cast("double"), c("n_beats_extracted").cast("double"))
    asked = [
        (c("morphology_error").isNotNull(), F.concat(F.lit("morphology_error: "), c("morphology_error"))),
        (c("n_beats_extracted") < p["min_beats_extracted"], _text("n_beats_extracted", c("n_beats_extracted"), "<", p["min_beats_extracted"])),
        (c("n_beats_good") < p["min_beats_good"], _text("n_beats_good", c("n_beats_good"), "<", p["min_beats_good"])),
    ]
    for name, value, bound in (("good_beats_ratio", share, p["good_beats_ratio_min"]), ("corr_median", c("corr_median"), p["corr_median_min"]), ("corr_min", c("corr_min"), p["corr_min_min"])):
        if bound is not None:
            asked.append((value.isNull() | (value < bound), _text(name, value, "<", bound)))
    if p["require_qrs"]:
        asked += [(c("QRS_main_idx").isNull(), F.lit("QRS_main_idx is missing")), (c("QRS_duration_ms").isNull(), F.lit("QRS_duration_ms is missing"))]
    width = c("QRS_duration_ms")
    if p["qrs_duration_min_ms"] is not None:
        asked.append((width.isNull() | (width < p["qrs_duration_min_ms"]), _text("QRS_duration_ms", width, "<", p["qrs_duration_min_ms"])))
    if p["qrs_duration_max_ms"] is not None:
        asked.append((width.isNull() | (width > p["qrs_duration_max_ms"]), _text("QRS_duration_ms", width, ">", p["qrs_duration_max_ms"])))
    for wave in "PT":
        if p[f"require_{wave.lower()}"]:
            asked.append((~F.coalesce(c(f"{wave}_present"), F.lit(False)), F.lit(f"{wave} wave required but not detected")))
    return _reasons(*asked)


def basic_qc(beats: DataFrame, keys: list[str], rr: str = "rr", low: float = 0.3, high: float = 2.0) -> DataFrame:
    """Per record of beats (keys, rr in seconds, NULL for the first): n_rpeaks, rr_phys_bad_ratio, mean_hr_bpm_rough."""
    x = F.col(rr)
    return beats.groupBy(*keys).agg(
        F.count("*").alias("n_rpeaks"),
        F.avg(F.when(x.isNotNull(), ((x < low) | (x > high)).cast("double"))).alias("rr_phys_bad_ratio"),
        F.try_divide(F.lit(60.0), F.avg(x)).alias("mean_hr_bpm_rough"),
    )


def clipping_ratio(x: Column, low: float = 0, high: float = 675) -> Column:
    """The share of samples at the bounds of the converter, as an aggregate."""
    return F.avg((x <= low + 2).cast("double")) + F.avg((x >= high - 2).cast("double"))


def suspicious_beats(beats: DataFrame, keys: list[str], order: list[str], rr: str = "rr", low: float = 0.35, high: float = 2.0, ratio_low: float = 0.70, ratio_high: float = 1.50, edge: Column | None = None) -> DataFrame:
    """beats with local_median, bad_rr, rr_outlier and suspicious.

    An interval is judged against the median of the five around it; both beats of a bad interval are suspicious, and so
    are beats near an edge of their record, if a condition for that is given (near_edge()).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    x = F.col(rr)
    seen = beats.withColumn("local_median", F.when(x.isNotNull(), F.percentile(rr, 0.5).over(w.rowsBetween(-2, 2))))
    m = F.col("local_median")
    seen = seen.withColumns({
        "bad_rr": F.coalesce((x < low) | (x > high), F.lit(False)),
        "rr_outlier": F.coalesce((m > 1e-9) & ((x < ratio_low * m) | (x > ratio_high * m)), F.lit(False)),
    })
    own = F.col("bad_rr") | F.col("rr_outlier")
    bad = own | F.coalesce(F.lead(own).over(w), F.lit(False))
    return seen.withColumn("suspicious", bad if edge is None else bad | F.coalesce(edge, F.lit(False)))


def near_edge(at: Column, total: Column, guard_sec: float = 0.5) -> Column:
    """Is a beat within guard_sec of the start or the end of its record?"""
    return (at < guard_sec) | (at >= total - guard_sec)


def review_outcome(mode: Column, passed: Column, said: Column, gate: Column) -> dict[str, Column]:
    """status, source and passed of a part of a record: from its gate, the mode of review, and what a reviewer said (null if
    nothing yet). The same rule as signal.record.decided(), over rows."""
    human = ~mode.isin("auto", "none") & ~((mode == "bad_only") & passed)
    return {
        "status": F.when(said.isNotNull(), said).when(human, "pending").when(passed, "accepted").otherwise("skipped"),
        "source": F.when(said == "accepted", "manual").when(said.isNotNull(), "manual_skipped").when(human, "manual").otherwise("auto"),
        "passed": F.when(said.isNotNull(), (said == "accepted") & F.coalesce(gate, F.lit(True))).otherwise(passed),
    }


def hrv_validated(status: str = "hrv_review_status", gate: str = "hrv_qc_passed") -> Column:
    """Accepted, and the gate passed if there was one."""
    return F.coalesce(F.col(status) == "accepted", F.lit(False)) & F.coalesce(F.col(gate), F.lit(True))


def morphology_validated(status: str = "morphology_review_status", gate: str = "morphology_qc_passed") -> Column:
    """Accepted, and the gate passed."""
    return F.coalesce(F.col(status) == "accepted", F.lit(False)) & F.coalesce(F.col(gate), F.lit(False))


def with_decisions(records: DataFrame, decisions: DataFrame, keys: list[str], statuses: list[str]) -> DataFrame:
    """records with the status columns of a table of human decisions where it has any."""
    found = decisions.select(*keys, *[F.col(s).alias(f"_{s}") for s in statuses])
    out = records.join(found, keys, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in statuses else F.col(c) for c in records.columns])


def invalidate(columns: list[str], prefix: str, valid: Column) -> list[Column]:
    """A projection of all columns that blanks those with the prefix where not valid."""
    return [F.when(valid, F.col(f"`{c}`")).alias(c) if c.startswith(prefix) else F.col(f"`{c}`") for c in columns]


def review_windows(peaks: Column, bad: Column, fs: float, window_sec: float = 8.0) -> Column:
    """Where a reviewer should look: starts of windows around the bad peaks, none within half a window of the last one.

    peaks: array of samples; bad: array of booleans of the same length.
    """
    times = F.array_sort(F.array_distinct(F.transform(F.filter(F.arrays_zip(peaks.alias("p"), bad.alias("b")), lambda x: x["b"]), lambda x: F.round(x["p"] / F.lit(float(fs)), 3))))
    starts = F.transform(times, lambda t: F.greatest(t - 0.5 * window_sec, F.lit(0.0)))

    def step(seen: Column, s: Column) -> Column:
        far = (F.size(seen) == 0) | (F.abs(s - F.element_at(seen, -1)) > 0.5 * window_sec)
        return F.when(far, F.concat(seen, F.array(s))).otherwise(seen)

    return F.when(F.size(peaks) == F.size(bad), F.aggregate(starts, F.array().cast("array<double>"), step)).otherwise(F.array().cast("array<double>"))


#: The columns of each feature group, by how they start.
GROUP_COLUMNS = {"hrv_time": ("hrv_time__",), "hrv_extended": ("hrv_freq__", "hrv_nonlinear__"), "morphology": ("morph_qrs__", "morph_p__", "morph_t__")}


def feature_groups(columns: list[str], groups: list[str]) -> list[str]:
    """The columns that stay when only some groups are wanted: those of no group always do. No group given: all."""
    gone = tuple(p for g, starts in GROUP_COLUMNS.items() if g not in groups for p in starts)
    return [c for c in columns if not groups or not c.startswith(gone or ("\0",))]
