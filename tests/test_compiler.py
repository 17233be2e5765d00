"""A small protocol from tables to dataset, reports, analysis and files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sigloom.plans import compiler, protocol

PROTOCOL = {
    "phases": ["before", "after"],
    "derived_features": {
        "defaults": {"quality_policy": "valid_only"},
        "feature_sets": {"core": {"features": ["hrv_time__SDNN_ms", "hrv_time__none"]}, "kept": {"features": ["hrv_time__SDNN_ms"]}},
        "sources": {"sit_before": {"phase": "before", "recording": "sit"}, "sit_after": {"phase": "after", "recording": "sit"}},
        "operations": [
            {"id": "response", "type": "pairwise", "left": "sit_after", "right": "sit_before", "feature_set": "core", "formulas": ["delta", "ratio"]},
            {"id": "twice", "type": "pairwise_derived", "left_operation": "response", "right_operation": "response", "base_formulas": ["delta"], "formulas": ["delta"]},
        ],
        "baseline_profiles": {"week": {"window_days": 7, "min_periods": 3, "statistic": "median", "scale": "iqr"}},
        "baseline_deviations": [{"id": "dev", "source": "sit_before", "feature_set": "kept", "baseline_profile": "week", "formulas": ["delta", "robust_z"]}],
    },
    "context_features": {
        "computed_columns": [{"id": "load", "type": "product", "columns": ["minutes", "rpe"]}],
        "feature_sets": {"all": {"features": ["sleep", "load"]}},
        "baseline_profiles": {"week": {"window_days": 7, "min_periods": 3}},
        "operations": [
            {"id": "change", "type": "lagged_pairwise", "feature_set": "all", "lag_days": 1, "formulas": ["delta"]}, {"id": "dev_ctx", "type": "baseline_deviation", "feature_set": "all", "baseline_profile": "week", "formulas": ["delta"]},
            {"id": "sums", "type": "rolling_aggregate", "feature_set": "all", "window_days": 7, "aggregations": ["sum", "std"]}, {"id": "pair", "type": "pairwise_columns", "pairs": [{"feature": "x", "left": "sleep", "right": "rpe"}], "formulas": ["delta"]},
        ],
    },
    "analysis_dataset": {
        "include": {"raw_ecg": {"sources": ["sit_before", "sit_after"], "feature_sets": ["kept"]}, "ecg_derived": {"operations": []}, "context_computed": {"feature_sets": ["all"]}, "context_derived": {"operations": ["change", "sums"]}},
        "targets": [{"id": "x", "source": "context_derived", "operation_id": "pair", "feature": "x", "formula": "delta", "label": "X"}, {"id": "gone", "source": "context_computed", "column": "nothing"}],
        "covariates": [{"id": "sleep", "source": "context_computed", "column": "sleep"}],
        "core_day_definition": {"required_ecg_sources": ["sit_before", "sit_after"], "required_context_columns": ["sleep"]},
    },
    "feature_analysis": {"target_analysis": {"targets": [{"column": "target__x", "direction": "higher_worse"}]}, "feature_scope": {"ecg_only": False, "exclude_roles": ["target", "meta", "qc"]}, "quality_rules": {"min_overlap_n": 5}},
}


@pytest.fixture(scope="module")
def tables(spark):
    day = lambda k: dt.date(2024, 3, 1) + dt.timedelta(k)
    raw = [(day(k), phase, "sit.csv", " full_record", 40.0 + (k * 7 + (phase == "after") * 3) % 11 if k % 9 else float("nan"), k % 10 != 4) for k in range(24) for phase in ("before", "after") if (k, phase) != (6, "after")]
    raw = spark.createDataFrame(raw, "date date, phase string, record_type string, segment_label string, hrv_time__SDNN_ms double, hrv_validated boolean")
    diary = spark.createDataFrame([(day(k), 7.0 + k % 4 if k % 6 else None, 30.0 + k, float(k % 5)) for k in range(24)], "date date, sleep double, minutes double, rpe double")
    p = protocol.compile_protocol(PROTOCOL)
    context = compiler.compute_context(diary, p)
    ecg = compiler.derive_ecg(raw, p)
    return p, {"raw_ecg_features": raw.withColumns({"record_type": F.lit("sit"), "segment_label": F.lit("full")}), "ecg_derived": ecg, "context_computed": context, "context_derived": compiler.derive_context(context, p)}


def test_derived_tables(tables):
    _, t = tables
    n = {(r.operation_id, r.reason): r["count"] for r in t["ecg_derived"].groupBy("operation_id", "reason").count().collect()}
    assert sum(v for (op, _), v in n.items() if op == "response") == 24 * 2 * 2 and n["response", "missing_left"] == 4 and n["response", "feature_missing"] == 23 * 2
    assert n["response", "hrv_validated=false;hrv_validated=false"] == 2 * 2 and n["twice", "invalid_left_or_right_derived"] > 0
    assert t["ecg_derived"].where("valid <> (reason = '')").count() == 0 and t["context_derived"].where("valid <> (reason = '')").count() == 0
    assert t["context_derived"].groupBy("operation_id").count().count() == 4


def test_dataset_reports_and_files(spark, tables, tmp_path):
    p, t = tables
    built = compiler.build_dataset(t, p)
    assert built.data.count() == 24 and built.data.where("complete_core_day").count() > 0
    # a column without any valid value is not there
    assert not [c for c in built.data.columns if "none" in c] and "target__x" in built.data.columns and "target__gone" not in built.data.columns
    targets = {r.target: r for r in built.reports["targets"].collect()}
    assert targets["gone"].reason == "missing_target_column" and targets["x"].present
    facts = built.summary()
    assert facts["n_rows"] == 24 and facts["n_columns"] == len(built.data.columns) and facts["n_targets"] == 2 and "target not usable: gone" in facts["warnings"]
    compiler.write_dataset(built, str(tmp_path))
    assert json.loads(spark.read.text(f"{tmp_path}/summary_json").first()[0])["n_rows"] == 24 and spark.read.parquet(f"{tmp_path}/dataset").count() == 24
    found = compiler.analyse(built, p, ["date"])
    assert found["ranking"].count() > 0 and found["across_targets"].count() > 0 and found["redundancy"].count() >= 0
    built.data.unpersist()


def test_without_recordings(tables):
    p, t = tables
    built = compiler.build_dataset({"context_computed": t["context_computed"], "context_derived": t["context_derived"], "raw_ecg_features": None}, p)
    assert built.data.count() == 24 and "coverage_by_day" not in built.reports
    built.data.unpersist()


def test_many_subjects_side_by_side(spark, tables):
    """With an entity key, two subjects with the same diary get the results that each gets alone."""
    p, t = tables
    two = t["context_computed"].crossJoin(spark.createDataFrame([("a",), ("b",)], "who string"))
    both = compiler.derive_context(two, p, ["who"])
    alone = t["context_derived"]
    for who in "ab":
        assert both.where(F.col("who") == who).drop("who").exceptAll(alone).count() == 0
    assert both.count() == 2 * alone.count()


def test_unknown_formulas_are_told(tables):
    bad = protocol.deep_merge(PROTOCOL, {"context_features": {"operations": [{"id": "o", "type": "lagged_pairwise", "formulas": ["cube"]}]}})
    assert compiler.check_formulas(protocol.compile_protocol(bad)) == ["o: cube"] and compiler.check_formulas(tables[0]) == []
