"""One query per operator over the driver's tables. Their SQL is in oracles.py.

`daily` (user x date, five event types as columns) stands in for a diary, `raw` (user x date x event type) for the table
of recordings, `beats` (a user's events in order of time) for heart beats, and embeddings for waves of 64 samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import scalars
from sigloom.functions.computed import with_computed
from sigloom.operators import analysis, dataset, derived, hrv, long_records, quality, ranks, reports, segments
from sigloom.plans.protocol import Source
from sigloom.schema import DERIVED_COLUMNS
from sigloom.ship import ship
from sigloom.sources import tables
from sigloom.streaming import windows

KEYS = ["user_id"]
TYPES = ["view", "click", "purchase", "signup", "error"]
PROFILE = {"window_days": 7, "min_periods": 3, "statistic": "median", "scale": "iqr"}
RAW_FEATURES = ["hrv_mean", "hrv_max", "morph_n", "hrv_none"]
FS = 64.0

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---------------------------------------------------------------- inputs


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    value = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(t)
    return e.groupBy("user_id", F.to_date("ts").alias("date")).agg(*map(value, TYPES))


def _whole(*by: str):
    """A group's rows in the order of events. The last bits of a sum depend on its order, and distinct means are counted by
    them, so where that is done values are added in this order, not in that in which tasks deliver them."""
    return Window.partitionBy(*by).orderBy("event_id", "ts", "value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def settled_daily(spark: SparkSession, d: str) -> DataFrame:
    """daily() with means that are the same to the last bit however files are split and read."""
    e = table(spark, d, "events").withColumn("date", F.to_date("ts"))
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value"))).over(_whole("user_id", "date")).alias(t)
    return e.select("user_id", "date", *map(mean, TYPES)).groupBy("user_id", "date").agg(*[F.max(t).alias(t) for t in TYPES])


def raw(spark: SparkSession, d: str, settled: bool = False) -> DataFrame:
    """settled: see settled_daily()."""
    e, mean = table(spark, d, "events").withColumns({"date": F.to_date("ts"), "phase": F.col("event_type")}), F.avg("value")
    if settled:
        e, mean = e.withColumn("mean", mean.over(_whole("user_id", "date", "phase"))), F.max("mean")
    per = e.groupBy("user_id", "date", "phase").agg(mean.alias("hrv_mean"), F.max("value").alias("hrv_max"), F.count("*").cast("double").alias("morph_n"))
    return per.select(
        "*", F.lit("sit").alias("record_type"), F.lit("full").alias("segment_label"), F.when(F.dayofmonth("date") % 5 != 0, F.col("user_id") % 4 != 0).alias("hrv_validated"), (F.col("user_id") % 3 != 0).alias("morphology_validated")
    )


def beats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)  # hours stand in for seconds
    return hrv.intervals(e.select("user_id", "event_id", t.alias("t")), KEYS, "t", ["t", "event_id"])


BEAT_ORDER = ["t", "event_id"]


def waves(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("label", "vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a few digits, dates as text: what both engines can be compared by."""
    out = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        out.append((F.round(x, digits) + F.lit(0.0) if kind == "double" else F.date_format(x, "yyyy-MM-dd") if kind == "date" else x).alias(c))
    return df.select(*out)


def _rows(df: DataFrame) -> DataFrame:
    return rounded(df.select(*KEYS, *DERIVED_COLUMNS))


# ---------------------------------------------------------------- computed columns


def _computed(spec: dict) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(with_computed(daily(spark, d), [spec | {"id": "value"}]).select("user_id", "date", "value"))

    return run


SPECS = {
    "computed_difference": {"type": "difference", "left": "view", "right": "click"},
    "computed_sum": {"type": "sum", "columns": ["view", "click", "purchase"]},
    "computed_product": {"type": "product", "columns": ["view", "click"]},
    "computed_ratio": {"type": "ratio", "numerator": "view", "denominator": "click"},
    "computed_weighted_sum": {"type": "weighted_sum", "weights": {"view": 0.25, "click": 2.0}},
    "computed_composite_mean": {"type": "composite_mean", "components": [{"column": "view"}, {"column": "click", "weight": 0.5}, {"column": "error", "invert": True, "max_value": 10, "min_value": 0}]},
}
_QUERIES |= {name: _computed(spec) for name, spec in SPECS.items()}


@query
def computed_chain(spark, d):
    """A declaration that uses earlier ones."""
    specs = [SPECS["computed_sum"] | {"id": "a"}, {"type": "ratio", "id": "b", "numerator": "a", "denominator": "view"}, {"type": "difference", "id": "c", "left": "b", "right": "a"}]
    return rounded(with_computed(daily(spark, d), specs).select("user_id", "date", "a", "b", "c"))


# ---------------------------------------------------------------- derived operations


def _pairwise(spark, d, formulas, left="view", right="click", operation="op", flags=False, policy="valid_only"):
    r = raw(spark, d).withColumn("segment", F.col("segment_label"))
    side = lambda s: tables.select_source(r, s, "sit", "full")
    why = quality.flag_reason(r.columns) if flags else None
    return derived.pairwise(side(left), side(right), r, RAW_FEATURES, formulas, operation=operation, left_source=left, right_source=right, keys=KEYS, quality=why, policy=policy)


def _one_formula(name: str) -> Query:
    return lambda spark, d: _rows(_pairwise(spark, d, [name]))


_QUERIES |= {f"pairwise_{f}": _one_formula(f) for f in ("delta", "percent_delta", "ratio", "log_ratio")}


@query
def pairwise_valid_only(spark, d):
    return _rows(_pairwise(spark, d, ["delta", "ratio"], flags=True))


@query
def pairwise_keep_invalid(spark, d):
    return _rows(_pairwise(spark, d, ["delta", "ratio"], flags=True, policy="keep"))


@query
def pairwise_derived(spark, d):
    a = _pairwise(spark, d, ["delta", "ratio"], "view", "click", "a")
    b = _pairwise(spark, d, ["delta", "ratio"], "purchase", "click", "b")
    return _rows(derived.pairwise_derived(a, b, ["delta", "percent_delta"], operation="op", left_source="a", right_source="b", base_formulas=["delta"], keys=KEYS))


PAIRS = [{"feature": "reach", "left": "view", "right": "click"}, {"feature": "sale", "left": "purchase", "right": "view"}, {"feature": "gone", "left": "view", "right": "nothing"}]


@query
def pairwise_columns(spark, d):
    return _rows(derived.pairwise_columns(daily(spark, d), PAIRS, ["delta", "percent_delta", "ratio", "log_ratio"], operation="op", keys=KEYS))


def _baseline(spark, d, formulas, profile=PROFILE, include_current=False, features=None):
    return _rows(derived.baseline_deviation(daily(spark, d), features or [*TYPES, "nothing"], formulas, operation="op", profile=profile, profile_name="p", include_current=include_current, keys=KEYS))


@query
def baseline_delta(spark, d):
    return _baseline(spark, d, ["delta"])


@query
def baseline_robust_z(spark, d):
    return _baseline(spark, d, ["delta", "robust_z"])


@query
def baseline_mean_std(spark, d):
    return _baseline(spark, d, ["robust_z"], PROFILE | {"statistic": "mean", "scale": "std"})


@query
def baseline_include_current(spark, d):
    return _baseline(spark, d, ["delta", "robust_z"], include_current=True)


@query
def baseline_of_source(spark, d):
    """Judged on all dates of the raw table, with flags."""
    r = raw(spark, d).withColumn("segment", F.col("segment_label"))
    return _rows(
        derived.source_baseline(
            tables.select_source(r, "view", "sit", "full"), ["hrv_mean", "morph_n", "hrv_none"], ["delta", "robust_z"], operation="op", profile=PROFILE, profile_name="p", keys=KEYS, source="view", spine=r,
            quality=quality.flag_reason(r.columns),
        )
    )


@query
def trailing_together(spark, d):
    """Two baselines and an aggregate over one exchange, as the compiler plans them."""
    ops = [
        derived.Baseline("week", ("view", "click"), ("delta", "robust_z"), PROFILE, "p"), derived.Baseline("mean", ("click", "error", "nothing"), ("delta",), PROFILE | {"statistic": "mean", "scale": "std", "window_days": 5}, "m"),
        derived.Rolling("sums", ("view", "error"), ("sum", "max"), 7, 2, True),
    ]
    return _rows(derived.trailing_operations(daily(spark, d), ops, KEYS))


def _lagged(days: int) -> Query:
    return lambda spark, d: _rows(derived.lagged_pairwise(daily(spark, d), [*TYPES, "nothing"], ["delta", "ratio"], operation="op", lag_days=days, keys=KEYS))


_QUERIES |= {"lagged_pairwise_1d": _lagged(1), "lagged_pairwise_7d": _lagged(7)}


@query
def rolling_aggregates(spark, d):
    return _rows(derived.rolling_aggregate(daily(spark, d), [*TYPES, "nothing"], list(derived.AGGREGATIONS), operation="op", window_days=7, min_periods=2, keys=KEYS))


@query
def rolling_include_current(spark, d):
    return _rows(derived.rolling_aggregate(daily(spark, d), ["view"], ["sum", "mean"], operation="op", window_days=3, include_current=True, keys=KEYS))


# ---------------------------------------------------------------- sources and scalars


@query
def source_selection(spark, d):
    """Names of records and segments in their normal form, then a source selected."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit(" "), "event_type").alias("phase"), F.concat("event_type", F.lit(".csv ")).alias("recording"), F.when(F.col("event_id") % 3 == 0, "whole").when(F.col("event_id") % 3 == 1, " start ").alias("segment_id"))
    return tables.select_source(tables.normal_raw(e), "view", "view", None).select("event_id", "phase", "record_type", "segment")


@query
def date_policy(spark, d):
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 10 == 0, F.lit("31.02.2024")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    df = tables.with_date(o.select("o_orderkey", text.alias("day")), "day", "%d.%m.%Y", "null")
    return rounded(df.select("o_orderkey", "day", "date"))


@query
def numeric_sniff(spark, d):
    """Columns that hold numbers with decimal commas, times, and words."""
    e = table(spark, d, "events")
    df = e.select("event_id", F.replace(F.round("value", 2).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("a"), F.concat(F.hour("ts").cast("string"), F.lit(":"), F.minute("ts").cast("string")).alias("b"), F.when(F.col("event_id") % 5 == 0, F.lit("none")).otherwise(F.col("event_id").cast("string")).alias("c"), "event_type")
    return rounded(scalars.with_numbers(df))


@query
def flags(spark, d):
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, ["true", " Yes", "y", "1", "no", "valid", "0", "bad"])), (F.col("event_id") % 8 + 1).cast("int")).alias("f"))
    f = F.col("f")
    return e.select("event_id", "f", scalars.flag(f).alias("is_set"), scalars.report_flag(f).alias("is_set_in_report"), scalars.is_false(f).alias("is_false"))


@query
def segment_names(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", scalars.segment_name(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size"))).alias("name"), scalars.half_even(F.col("p_retailprice") / 2).alias("half"))


# ---------------------------------------------------------------- segments


def _segments(profile: dict) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 97 / 4.0).alias("duration_sec"))
        return rounded(segments.explode_segments(r, profile)).drop("duration_sec")

    return run


SEGMENTS = {
    "segments_full": {"mode": "full"},
    "segments_fixed": {"mode": "fixed_windows", "window_sec": 5.0, "step_sec": 5.0, "min_window_sec": 2.0, "drop_last_short_window": True},
    "segments_sliding": {"mode": "fixed_windows", "window_sec": 5.0, "step_sec": 2.0, "drop_last_short_window": False},
    "segments_named": {"mode": "named_subsegments", "segments": [{"label": "full", "start_sec": 0.0, "end_sec": "full"}, {"label": "start", "start_sec": 0.0, "end_sec": 5.0}, {"label": "end", "relative_to": "end", "duration_sec": 5.0}]},
}
_QUERIES |= {name: _segments(p) for name, p in SEGMENTS.items()}


@query
def segment_cut(spark, d):
    """Samples and peaks of a part of a wave."""
    e = table(spark, d, "embeddings")
    x, fs = F.col("embedding"), F.lit(FS)
    lo, hi = F.lit(0.21), F.lit(0.73)
    peaks = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (i * 8 - F.col("vec_id") % 5).cast("int"))
    part = segments.cut(x, fs, lo, hi)
    near = segments.without_edge(peaks, F.size(x), fs, 0.1)
    total = F.aggregate(part, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return rounded(e.select("vec_id", F.size(part).alias("n"), total.alias("total"), F.array_join(segments.rebased_peaks(near, fs, lo, hi), ",").alias("peaks"), segments.long_enough(F.size(x), fs).alias("long_enough")), 4)


# ---------------------------------------------------------------- beats


@query
def rr_intervals(spark, d):
    return rounded(beats(spark, d).select("user_id", "event_id", "rr"))


@query
def rr_time_domain(spark, d):
    return rounded(hrv.time_domain(beats(spark, d), KEYS, BEAT_ORDER), 3)


@query
def rr_poincare(spark, d):
    return rounded(hrv.poincare(beats(spark, d), KEYS, BEAT_ORDER), 2)


@query
def rr_shannon(spark, d):
    return rounded(hrv.shannon_entropy(beats(spark, d), KEYS))


@query
def rr_entropies(spark, d):
    return rounded(hrv.nonlinear(beats(spark, d), KEYS, BEAT_ORDER).select("user_id", "ApproxEntropy", "SampleEntropy"))


@query
def rr_fractals(spark, d):
    return rounded(hrv.nonlinear(beats(spark, d), KEYS, BEAT_ORDER).select("user_id", "DFA_alpha1", "DFA_alpha2", "FractalDimension"), 5)


@query
def rr_frequency(spark, d):
    """Band powers of the resampled intervals, in Arrow batches."""
    from sigloom.signal import hrv as h

    @F.pandas_udf(", ".join(f"{n} double" for n in h.FREQ_NAMES))
    def run(series):
        import numpy as np
        import pandas as pd

        return pd.DataFrame([h.frequency_domain(np.asarray(x, float) / 1000.0) for x in series], columns=list(h.FREQ_NAMES), dtype="float64")

    per = hrv._series(beats(spark, d), KEYS, BEAT_ORDER).select("user_id", run("x").alias("f")).select("user_id", "f.*")
    return rounded(per.select("user_id", *[F.nanvl(F.col(n), F.lit(None).cast("double")).alias(n) for n in h.FREQ_NAMES]))


@query
def basic_qc(spark, d):
    return rounded(quality.basic_qc(beats(spark, d), KEYS, low=2.0, high=40.0))


@query
def clipping(spark, d):
    return rounded(table(spark, d, "events").groupBy("user_id").agg(quality.clipping_ratio(F.col("value"), 0, 100).alias("clipping_ratio")))


@query
def suspicious_beats(spark, d):
    b = quality.suspicious_beats(beats(spark, d), KEYS, BEAT_ORDER, low=1.0, high=40.0)
    return rounded(b.select("user_id", "event_id", "local_median", "bad_rr", "rr_outlier", "suspicious"))


@query
def signal_gate(spark, d):
    b = quality.suspicious_beats(beats(spark, d), KEYS, BEAT_ORDER, low=1.0, high=40.0)
    per = b.groupBy("user_id").agg(F.count("*").alias("n_rpeaks"), (F.count(F.when(F.col("bad_rr"), 1)) * 100 / F.count("rr")).cast("long").cast("double").alias("rr_phys_bad_ratio"), (F.count(F.when(F.col("suspicious"), 1)) * 100 / F.count("*")).cast("long").cast("double").alias("suspicious_ratio"))
    per = per.withColumns({"rpeak_amp_bad_ratio": F.when(F.col("user_id") % 2 == 0, (F.col("user_id") % 7).cast("double")), "rpeak_amp_median": F.col("user_id").cast("double")})
    limits = {"bad_rr_fraction_max": 10.0, "suspicious_peak_fraction_max": 50.0, "min_rpeaks": 60, "rpeak_amp_bad_ratio_max": 3.0, "rpeak_amp_median_min": 20.0}
    why = quality.signal_gate(limits)
    return per.select("user_id", F.array_join(why, ";").alias("reasons"), (F.size(why) == 0).alias("passed"))


@query
def morphology_gate(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    per = p.select(
        "p_partkey", F.when(k % 11 == 0, "no_median_beat").alias("morphology_error"), (k % 9).alias("n_beats_extracted"), (k % 5).alias("n_beats_good"), F.when(k % 7 != 0, (k % 10) / 10.0).alias("corr_median"), F.lit(0.5).alias("corr_min"),
        F.when(k % 6 != 0, k % 40).alias("QRS_main_idx"), F.when(k % 6 != 0, (k % 250).cast("double")).alias("QRS_duration_ms"), (k % 2 == 0).alias("P_present"), F.lit(None).cast("boolean").alias("T_present"),
    )
    why = quality.morphology_gate({"require_p": True, "good_beats_ratio_min": None, "corr_median_min": None})
    return per.select("p_partkey", F.array_join(why, ";").alias("reasons"))


@query
def validation_flags(spark, d):
    """Automatic statuses, human decisions over them, and the features blanked where not valid."""
    e = table(spark, d, "events").select("event_id", "value", F.when(F.col("event_id") % 3 == 0, "skipped").otherwise("accepted").alias("hrv_review_status"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 5 != 0).alias("hrv_qc_passed"))
    human = e.where("event_id % 6 = 0").select("event_id", F.lit("accepted").alias("hrv_review_status"))
    e = quality.with_decisions(e, human, ["event_id"], ["hrv_review_status"]).withColumnRenamed("value", "hrv_x")
    ok = quality.hrv_validated()
    return rounded(e.select(*quality.invalidate(e.columns, "hrv_x", ok), ok.alias("hrv_ok"), quality.morphology_validated("hrv_review_status", "hrv_qc_passed").alias("morph_ok")))


@query
def review_windows(spark, d):
    """Windows around the beats of a user that an interval of more than 18 hours ends."""
    b = beats(spark, d).withColumn("k", F.floor(F.col("t") - F.lit(473352.0)).cast("int"))
    row = F.struct("t", "event_id", "k", F.coalesce(F.col("rr") > 18.0, F.lit(False)).alias("bad"))
    per = b.groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    starts = quality.review_windows(F.transform("r", lambda x: x["k"]), F.transform("r", lambda x: x["bad"]), 1.0, 48.0)
    return rounded(per.select("user_id", F.posexplode(starts).alias("pos", "start")))


# ---------------------------------------------------------------- waves


@query
def median_wave(spark, d):
    return rounded(hrv.median_wave(waves(spark, d), ["label"]))


@query
def template_correlation(spark, d):
    return rounded(hrv.template_correlation(waves(spark, d), ["label"], "vec_id", threshold=0.1).drop("good"), 5)


@query
def wave_area(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return rounded(table(spark, d, "embeddings").select("vec_id", hrv.area_over_chord(x, FS).alias("area")))


@query
def wave_width(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return rounded(table(spark, d, "embeddings").select("vec_id", hrv.width_at_fraction(x, F.lit(32), FS, 0.5).alias("width_ms")))


# ---------------------------------------------------------------- dataset and reports


def _sources() -> list[Source]:
    return [Source(t, t, "sit", "full") for t in ("view", "click", "purchase")]


@query
def wide_raw(spark, d):
    return rounded(dataset.wide_raw(raw(spark, d), _sources(), ["hrv_mean", "morph_n"], KEYS)[0])


def _columns_op(spark, d, days=daily):
    return derived.pairwise_columns(days(spark, d), PAIRS, ["delta", "ratio"], operation="op", keys=KEYS).withColumn("date", F.col("date").cast("date"))


@query
def wide_derived(spark, d):
    """Columns without any value are not there."""
    return rounded(dataset.wide_derived(_columns_op(spark, d), KEYS, "der")[0])


@query
def wide_context(spark, d):
    return rounded(dataset.wide_context(daily(spark, d), ["view", "click", "nothing"], KEYS)[0])


@query
def first_non_null(spark, d):
    """The first value that is there, by an explicit order."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("date"), F.col("event_id").alias("_ord"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return rounded(dataset.wide_context(e, ["v"], KEYS)[0])


ITEMS = [
    {"id": "sale", "source": "derived", "operation_id": "op", "feature": "sale", "formula": "delta", "label": "Sales response", "direction": "higher_worse", "horizon": "acute", "data_type": "numeric", "scale_type": "continuous"},
    {"id": "view", "source": "context", "column": "view", "label": "Views", "direction": "higher_better", "horizon": "same_day", "data_type": "numeric", "scale_type": "continuous"},
]


@query
def named_items(spark, d):
    context = daily(spark, d)
    parts = dataset.named_items(ITEMS, {"derived": _columns_op(spark, d), "context": context}, KEYS, "target")
    return rounded(dataset.assemble(dataset.spine([context], KEYS), [p for p, _ in parts], KEYS))


@query
def qc_summary(spark, d):
    return rounded(dataset.qc_summary(raw(spark, d), _sources(), KEYS, daily(spark, d), ["view", "error"]))


def _dataset(spark, d, days=daily):
    context, r = days(spark, d), raw(spark, d)
    w, _ = dataset.wide_raw(r, _sources(), ["hrv_mean"], KEYS)
    c, _ = dataset.wide_context(context, TYPES, KEYS)
    t = [p for p, _ in dataset.named_items(ITEMS, {"derived": _columns_op(spark, d, days), "context": context}, KEYS, "target")]
    return dataset.assemble(dataset.spine([context, r], KEYS), [w, c, *t], KEYS)


@query
def analysis_dataset(spark, d):
    return rounded(_dataset(spark, d))


TARGET_COLUMNS = {"sale": "target__sale", "view": "target__view"}


@query
def report_summarize(spark, d):
    return rounded(reports.summarize(settled_daily(spark, d), TYPES))


@query
def report_completeness(spark, d):
    return rounded(reports.completeness(settled_daily(spark, d), ["view", "error", "nothing"]))


@query
def report_targets(spark, d):
    return rounded(reports.targets(_dataset(spark, d, settled_daily), [*ITEMS, {"id": "none", "label": "x"}], TARGET_COLUMNS | {"none": "target__none"}))


CTX = [f"ctx__{t}" for t in TYPES]


def _catalog(spark):
    return dataset.catalog_table(spark, [{"column": c, "role": "input", "source_table": "context_computed", "feature_family": "context"} for c in CTX] + [{"column": "target__view", "role": "target", "source_table": "context"}])


@query
def report_availability(spark, d):
    return rounded(reports.availability(_dataset(spark, d, settled_daily), _catalog(spark)))


@query
def report_overlap(spark, d):
    return rounded(reports.overlap(_dataset(spark, d), TARGET_COLUMNS, CTX))


@query
def report_readiness(spark, d):
    df = _dataset(spark, d)
    return rounded(reports.readiness(reports.targets(df, ITEMS, TARGET_COLUMNS), reports.overlap(df, TARGET_COLUMNS, CTX)))


@query
def report_ecg_quality(spark, d):
    return rounded(reports.ecg_quality(raw(spark, d)))


@query
def report_derived_operations(spark, d):
    return rounded(reports.derived_operations(derived.pairwise_columns(daily(spark, d), PAIRS, ["delta", "ratio"], operation="op", keys=KEYS), "context_derived"))


@query
def report_coverage(spark, d):
    return reports.coverage(dataset.qc_summary(raw(spark, d), _sources(), KEYS, need_hrv=False), KEYS).withColumn("date", F.col("date").cast("string"))


@query
def report_summary(spark, d):
    df = _dataset(spark, d)
    return reports.summary(df, reports.targets(df, ITEMS, TARGET_COLUMNS), reports.availability(df, _catalog(spark)))


# ---------------------------------------------------------------- analysis

FEATURES = ["click", "purchase", "signup"]
ROW = ["user_id", "date"]


def _pairs(spark, d):
    return analysis.pairs(daily(spark, d), ROW, ["view", "error"], FEATURES)


@query
def spearman(spark, d):
    return rounded(analysis.spearman(_pairs(spark, d)))


@query
def spearman_by_parts(spark, d):
    """The same with parts of 500 distinct values, as large tables have them: no task orders a pair."""
    return rounded(analysis.spearman(_pairs(spark, d), part=500))


def _by_user(spark, d):
    """One row a user: what stability and ranks are made for is tens to thousands of rows."""
    per = daily(spark, d).groupBy("user_id").agg(*[F.avg(t).alias(t) for t in TYPES])
    return per.select("user_id", *[F.round(t, 6).alias(t) for t in TYPES])


@query
def direction_stability(spark, d):
    return rounded(analysis.direction_stability(analysis.pairs(_by_user(spark, d), ["user_id"], ["view"], FEATURES)))


@query
def stability_by_parts(spark, d):
    return rounded(analysis.direction_stability(analysis.pairs(_by_user(spark, d), ["user_id"], ["view"], FEATURES), part=10))


@query
def redundancy_of_days(spark, d):
    """Features that are there on different rows each: ranked pair by pair, by parts."""
    return rounded(analysis.redundancy(daily(spark, d), ROW, TYPES, 0.0, part=500))


@query
def exact_quantiles(spark, d):
    """Quantiles of each kind of event, bracketed and then exact."""
    e = table(spark, d, "events").select("event_type", F.col("value").cast("double").alias("v"))
    q = ranks.exact_quantiles(e, ["event_type"], "v", [0.05, 0.25, 0.5, 0.95])
    return rounded(q.select("event_type", *[F.col("q")[k].alias(n) for k, n in enumerate(("p05", "p25", "p50", "p95"))]))


@query
def redundancy(spark, d):
    return rounded(analysis.redundancy(_by_user(spark, d), ["user_id"], TYPES, 0.05))


@query
def ranking(spark, d):
    both = analysis.pairs(_by_user(spark, d), ["user_id"], ["view", "error"], FEATURES)
    return rounded(analysis.ranking(analysis.spearman(both), analysis.direction_stability(both), min_abs=0.05))


@query
def multi_target(spark, d):
    both = analysis.pairs(_by_user(spark, d), ["user_id"], ["view", "error"], FEATURES)
    return rounded(analysis.across_targets(analysis.ranking(analysis.spearman(both), analysis.direction_stability(both), min_abs=0.0, min_stability=0.0), 2))


@query
def directed_targets(spark, d):
    return rounded(daily(spark, d).select("user_id", "date", analysis.directed(F.col("view"), "higher_better").alias("view"), analysis.directed(F.col("error"), "higher_worse").alias("error")))


@query
def feature_rules(spark, d):
    return rounded(analysis.quality_rules(reports.summarize(settled_daily(spark, d), TYPES), 0.5, 4).select("column", "missing_ratio", "n_unique"))


@query
def feature_rules_met(spark, d):
    """Rules that some columns meet and one does not: the raw table's, of which one is absent half of the time."""
    r = raw(spark, d, settled=True).select("hrv_mean", "morph_n", F.when(F.col("hrv_validated"), F.col("hrv_max")).alias("hrv_max"), F.when(F.col("morph_n") > 1, F.col("hrv_mean")).alias("often_gone"))
    return rounded(analysis.quality_rules(reports.summarize(r, ["hrv_mean", "hrv_max", "morph_n", "often_gone"]), 0.5, 4).select("column", "missing_ratio", "n_unique"))


@query
def suspicious_near_edges(spark, d):
    """Beats near the start or the end of their record are suspicious as well; hours stand in for seconds."""
    w = Window.partitionBy(*KEYS)
    b = beats(spark, d).withColumns({"at": F.col("t") - F.min("t").over(w), "total": F.max("t").over(w) - F.min("t").over(w)})
    edge = quality.near_edge(F.round("at", 3), F.round("total", 3), 24.0)
    return quality.suspicious_beats(b, KEYS, BEAT_ORDER, low=1.0, high=40.0, ratio_low=0.7, ratio_high=1.5, edge=edge).select("user_id", "event_id", "suspicious")


@query
def review_outcomes(spark, d):
    """What the modes of review make of gates and reviewers' words."""
    e, k = table(spark, d, "events"), F.col("event_id")
    mode = F.when(k % 4 == 0, "auto").when(k % 4 == 1, "manual").when(k % 4 == 2, "bad_only").otherwise("none")
    said, gate = F.when(k % 5 == 0, "accepted").when(k % 5 == 1, "skipped"), F.when(k % 3 != 0, k % 2 == 0)
    return e.select("event_id", *[c.alias(n) for n, c in quality.review_outcome(mode, F.col("value") > 40, said, gate).items()])


@query
def templated_names(spark, d):
    """A protocol's own templates name the columns of the dataset."""
    template = "{feature}.{phase}.{recording}"
    wide, catalog = dataset.wide_raw(raw(spark, d), _sources(), ["hrv_mean"], KEYS, "x", template=template)
    return rounded(wide.select("user_id", "date", *[F.col(f"`{c['column']}`").alias(c["column"].replace(".", "_")) for c in catalog]))


@query
def report_top(spark, d):
    """The first rows of a report in the order in which it is written."""
    report = reports.derived_operations(derived.pairwise_columns(daily(spark, d), PAIRS, ["delta", "ratio"], operation="op", keys=KEYS), "context_derived")
    return rounded(reports.top(report, "derived_operations", 1))


# ---------------------------------------------------------------- windows of event time, recordings


@query
def event_windows(spark, d):
    e = table(spark, d, "events")
    return rounded(windows.windowed(e, ["event_type"], "6 hours").withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")}))


@query
def event_sessions(spark, d):
    e = table(spark, d, "events")
    return rounded(windows.sessions(e, ["user_id"], "6 hours").withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")}))


@query
def recording_features(spark, d):
    """Stage 1 on synthetic recordings, one per user: peaks, gates, intervals and shapes of every segment."""
    import numpy as np
    import pandas as pd

    from sigloom.plans.protocol import morphology_limits, signal_limits
    from sigloom.signal import record, synthetic
    from sigloom.sources.signals import FEATURE_DDL, FEATURE_FIELDS

    profile = {"expected_hr_bpm": {"min": 40, "max": 130}, "morphology": {"enabled": True, "expected_qrs_duration_ms": {"min": 40, "max": 140}}}
    plan = {"signal_limits": signal_limits(profile), "morphology_limits": morphology_limits(profile), "feature_groups": ["hrv_time", "hrv_extended", "morphology"], "corr_threshold": 0.8, "review_scope": "record", "segmentation": {"mode": "full"}}
    names = [n for n, _ in FEATURE_FIELDS]

    def run(batches):
        for batch in batches:
            rows = []
            for user in batch.user_id:
                x, _ = synthetic.recording(40.0, int(user), hr=55.0 + user % 50)
                rows += [r | {"record_type": "sit", "phase": "before", "date": f"{int(user)}"} for r in record.process(np.asarray(x), 234.45, plan)]
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names, dtype=object)

    # few small rows that cost much each: a set number of tasks, so that they are not put together
    users = table(spark, d, "events").select("user_id").distinct().repartition(4 * spark.sparkContext.defaultParallelism, "user_id")
    return users.mapInPandas(run, FEATURE_DDL)


def label_signals(spark, d, per_chunk: int = 32) -> DataFrame:
    """The vectors of a label, one after the other, as one long signal of 64 samples a second, in chunks."""
    e = table(spark, d, "embeddings").select("label", "vec_id", "embedding")
    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = e.join(e.select("label", "vec_id", at.alias("at")), ["label", "vec_id"])  # vectors are shuffled by chunk, numbers by label
    own = F.sort_array(F.collect_list(F.struct("at", F.transform("embedding", lambda x: x.cast("double")).alias("x"))))
    return rows.groupBy("label", F.floor(F.col("at") / per_chunk).alias("chunk")).agg(F.flatten(F.transform(own, lambda p: p["x"])).alias("x"))


@query
def long_recording_peaks(spark, d):
    """Peaks of long recordings, found chunk by chunk with their neighbours' halo."""
    return long_records.long_peaks(label_signals(spark, d), ["label"], FS)
