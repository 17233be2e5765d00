"""Protocol, feature sets, sources, recordings, dataset, reports and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sigloom.operators import analysis, dataset, quality, reports, segments
from sigloom.plans import feature_sets, protocol
from sigloom.plans.protocol import Source
from sigloom.signal import record, synthetic
from sigloom.sources import signals, tables
from sigloom.streaming import windows

PROTOCOL = {
    "subject_defaults": {"sampling_rate_mode": "fixed", "sampling_rate_hz": 234.45},
    "storage": {"date_format": "%d.%m.%Y"},
    "defaults": {"review_mode": "auto", "segmentation": "full_record", "quality_profile": "resting", "feature_groups": ["hrv_time", "hrv_extended", "morphology"]},
    "phases": [{"id": "before"}, "after"],
    "quality_profiles": {"resting": {"expected_hr_bpm": {"min": 40, "max": 120}, "morphology": {"enabled": True, "expected_qrs_duration_ms": {"min": 30, "max": 160}}}, "load": {"expected_hr_bpm": {"min": 60, "max": 200}}},
    "segmentation_profiles": {"full_record": {"mode": "full"}, "w5": {"mode": "fixed_windows", "window_sec": 5.0, "step_sec": 5.0, "min_window_sec": 2.0, "drop_last_short_window": True}},
    "recordings": [{"id": "sit", "file_names": ["sit.csv", "sitting.csv"], "phases": ["before"]}, {"id": "squat", "file_names": ["squat.csv"], "segmentation": "w5", "review_scope": "segment", "quality_profile": "load", "feature_groups": ["hrv_time"]}],
    "derived_features": {"sources": {"sit_before": {"phase": "before", "recording": "sit"}}, "operations": [{"id": "x", "type": "pairwise", "left": "sit_before", "right": "sit_before"}]},
}


def test_protocol(tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps(PROTOCOL))
    p = protocol.compile_protocol(protocol.load(path))
    assert p.date_format == "dd.MM.yyyy" and p.phases == ("before", "after") and [(x.recording, x.phase) for x in p.plans] == [("sit", "before"), ("squat", "before"), ("squat", "after")]
    sit, squat = p.plans[:2]
    assert sit.signal_limits["rr_min_sec"] == 0.5 and sit.signal_limits["rr_max_sec"] == 1.5 and sit.morphology_limits["qrs_duration_max_ms"] == 160 and squat.morphology_limits is None
    assert p.sources["sit_before"] == Source("sit_before", "before", "sit", "full")
    (tmp_path / "p.txt").write_text("")
    with pytest.raises(protocol.ProtocolError):
        protocol.load(tmp_path / "p.txt")


def test_protocol_errors_come_together():
    bad = protocol.deep_merge(PROTOCOL, {"phases": ["a", "a"], "segmentation_profiles": {"full_record": {"mode": "spiral"}}, "derived_features": {"operations": [{"id": "y", "type": "pairwise_derived", "left_operation": "x", "right_operation": "z"}]}})
    with pytest.raises(protocol.ProtocolError) as e:
        protocol.compile_protocol(bad)
    assert len(str(e.value).splitlines()) >= 4


def test_deep_merge_replaces_lists():
    assert protocol.deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}


def test_feature_sets(spark):
    df = spark.createDataFrame([], "hrv_time__n_rr bigint, hrv_time__SDNN_ms double, morph_qrs__R_idx double, morph_qrs__QRS_area double, morph_p__P_present boolean, other double")
    sets = {"a": {"features": ["x", "other"]}, "b": {"include_prefixes": ["hrv_"], "exclude": ["hrv_time__n_rr"]}, "c": {"include_feature_sets": ["b", "a"]}, "loop": {"include_feature_sets": ["loop"]}}
    assert feature_sets.resolve(df, sets, "full") == ["hrv_time__SDNN_ms", "morph_qrs__QRS_area"]
    assert feature_sets.resolve(df, sets, "a") == ["x", "other"] and feature_sets.resolve(df, sets, "c") == ["hrv_time__SDNN_ms", "other", "x"]
    for name in ("loop", "none"):
        with pytest.raises(ValueError):
            feature_sets.resolve(df, sets, name)
    assert feature_sets.union(["b", "hrv_time__S"], sets, df.columns, strict=False) == ["hrv_time__SDNN_ms"]
    with pytest.raises(ValueError):
        feature_sets.union(["a"], sets, df.columns)


def test_the_full_set_has_61_features(spark):
    df = spark.createDataFrame([], signals.FEATURE_DDL)
    assert len(feature_sets.resolve(df, {}, "full")) == 61


def test_diary(spark, tmp_path):
    (tmp_path / "d.csv").write_text("﻿Date;Sleep;Clock;Note;;\n01.04.2026;7,5;22:30;ok;;\n02.04.2026;8;23:00;;;\nbad;6;21:00;x;;\n", encoding="utf-8")
    df = tables.read_diary(spark, str(tmp_path / "d.csv"))
    assert dict(df.dtypes)["Sleep"] == "double" and dict(df.dtypes)["Clock"] == "string" and [r.date for r in df.orderBy("_ord").collect()] == [dt.date(2026, 4, 1), dt.date(2026, 4, 2), None]
    with pytest.raises(ValueError, match="bad"):
        tables.with_date(tables.read_csv(spark, str(tmp_path / "d.csv"), sep=";"), "Date", "%d.%m.%Y").count()


def test_tables_required_or_not(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([("2024-01-01", 1.5)], "date string, v double"), str(tmp_path / "a.csv"))
    spec = {"a": {"path": "a.csv"}, "b": {"path": "none.csv", "required": False}}
    got = tables.read_tables(spark, spec, str(tmp_path))
    assert got["b"] is None and got["a"].count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_tables(spark, {"b": {"path": "none.csv"}}, str(tmp_path))


def test_days_are_overwritten_one_by_one(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "date string, v int")
    tables.write_days(rows(("d1", 1), ("d2", 2)), str(tmp_path / "t"))
    tables.write_days(rows(("d2", 3)), str(tmp_path / "t"))
    assert sorted((r.date, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("d1", 1), ("d2", 3)]


def test_reviews(spark, tmp_path):
    one = {"signal_review": {"status": "skipped", "signal": None, "rpeaks": [1, 2]}, "hrv_review": {"status": "skipped", "qc_gate": {"passed": False, "reasons": ["x"]}}, "meta": {"date": "01.04.2026", "phase": "before"}}
    (tmp_path / "r.json").write_text(json.dumps(one, indent=1))
    row = tables.read_reviews(spark, str(tmp_path)).first()
    assert row.signal_review.rpeaks == [1, 2] and row.hrv_review.qc_gate.reasons == ["x"] and row.meta.phase == "before"
    tables.write_reviews(spark.createDataFrame([(float("nan"), "a")], "x double, y string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().x is None


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    root = tmp_path_factory.mktemp("signals")
    for day in ("01.04.2026", "02.04.2026"):
        for phase, name, seconds in (("before", "sitting.csv", 40), ("after", "squat.csv", 22), ("before", "other.csv", 5)):
            if (day, name) != ("02.04.2026", "squat.csv"):
                folder = root / day / phase
                folder.mkdir(parents=True, exist_ok=True)
                x, _ = synthetic.recording(seconds, len(day) + seconds, hr=75)
                (folder / name).write_text("\n".join(str(int(v)) for v in x))
    (root / "_reviews").mkdir()
    return str(root)


def test_recordings_to_features(spark, recordings):
    p = protocol.compile_protocol(PROTOCOL)
    files = signals.find_recordings(spark, recordings)
    found = signals.planned(files, p)
    assert sorted((r.date, r.recording) for r in found.select("date", "recording").collect()) == [("01.04.2026", "sit"), ("01.04.2026", "squat"), ("02.04.2026", "sit")]
    assert {(r.date, r.phase, r.recording) for r in signals.missing(files, p).collect()} == {("01.04.2026", "before", "squat"), ("02.04.2026", "before", "squat"), ("02.04.2026", "after", "squat")}
    out = signals.extract_features(found, p)
    assert [(c, k) for c, k in out.dtypes] == signals.FEATURE_FIELDS
    rows = out.collect()
    assert len([r for r in rows if r.record_type == "squat"]) == 4 and all(r.hrv_freq__LF_power is None and r.morph_qrs__R_idx is None for r in rows if r.record_type == "squat")
    sit = [r for r in rows if r.record_type == "sit"]
    assert all(r.hrv_validated and 70 < r.hrv_time__MeanHR_bpm < 80 for r in sit)


def test_reviews_decide_on_recordings(spark, recordings, tmp_path):
    """Written reviews, read again, settle what the mode leaves to people; the store follows them."""
    p = protocol.compile_protocol(protocol.deep_merge(PROTOCOL, {"defaults": {"review_mode": "manual"}}))
    found = signals.planned(signals.find_recordings(spark, recordings), p)
    row = lambda date, status: {"signal_review": {"status": status}, "hrv_review": {"status": status, "qc_gate": {"passed": status == "accepted"}}, "meta": {"date": date, "phase": "before", "record_type": "sit"}}
    folder = tmp_path / "reviews"
    folder.mkdir()
    for k, (date, status) in enumerate((("01.04.2026", "accepted"), ("02.04.2026", "skipped"))):
        (folder / f"{k}.json").write_text(json.dumps(row(date, status)))
    said = tables.decisions(tables.read_reviews(spark, str(folder)))
    got = {(r.date, r.record_type): (r.hrv_review_status, r.hrv_validated) for r in signals.extract_features(found, p, said).collect()}
    assert got == {("01.04.2026", "sit"): ("accepted", True), ("02.04.2026", "sit"): ("skipped", False), ("01.04.2026", "squat"): ("pending", False)}
    store = str(tmp_path / "store")
    n = signals.stored_features(found, p, store).count()
    assert signals.stored_features(found, p, store, said).where("hrv_validated").count() > 0 and spark.read.parquet(store).where("record_type = 'sit'").count() == 2 * (n - 4)


def test_files_that_are_no_signals(spark, tmp_path):
    for date, text in (("01.04.2026", "1\n2\nx\n"), ("02.04.2026", "\n")):
        folder = tmp_path / date / "before"
        folder.mkdir(parents=True)
        (folder / "sitting.csv").write_text(text)
    p = protocol.compile_protocol(PROTOCOL)
    found = signals.planned(signals.find_recordings(spark, str(tmp_path)), p)
    assert signals.extract_features(found, p).count() == 0
    assert sorted((r.date, r.reason) for r in signals.unreadable(found, p).collect()) == [("01.04.2026", "not_numeric"), ("02.04.2026", "not_numeric")]


def test_stored_features(spark, recordings, tmp_path):
    """What is stored is not processed again, unless its plan has changed."""
    files = signals.find_recordings(spark, recordings)
    store = str(tmp_path / "store")
    ask = lambda p: signals.stored_features(signals.planned(files, p), p, store).count()
    p = protocol.compile_protocol(PROTOCOL)
    n = ask(p)
    assert n == 6 and ask(p) == n and spark.read.parquet(store).count() == n
    other = protocol.compile_protocol(protocol.deep_merge(PROTOCOL, {"quality_profiles": {"resting": {"expected_hr_bpm": {"max": 110}}}}))
    assert ask(other) == n and spark.read.parquet(store).count() == n + 2


def test_feature_groups():
    columns = ["date", "hrv_time__a", "hrv_freq__b", "morph_p__c", "qc__d"]
    assert quality.feature_groups(columns, ["hrv_time"]) == ["date", "hrv_time__a", "qc__d"] and quality.feature_groups(columns, []) == columns
    assert quality.feature_groups(columns, ["hrv_time", "hrv_extended", "morphology"]) == columns


def test_segments_agree_with_the_signal_layer(spark):
    for profile in (PROTOCOL["segmentation_profiles"]["w5"], {"mode": "fixed_windows", "window_sec": 4.0, "step_sec": 1.5, "drop_last_short_window": False}, {"mode": "full"}, {"mode": "named_subsegments", "segments": [{"label": "a", "start_sec": 1, "end_sec": 9}, {"label": "z", "relative_to": "end", "duration_sec": 3}]}):
        for total in (0.5, 5.0, 11.9, 12.0):
            got = segments.explode_segments(spark.createDataFrame([(total,)], "duration_sec double"), profile).collect()
            assert [(r.label, r.start_sec, r.end_sec, r.window_idx) for r in got] == record.segment_bounds(total, profile)
    with pytest.raises(ValueError):
        segments.segments(F.lit(1.0), {"mode": "spiral"})


def test_edits_of_peaks(spark):
    df = spark.createDataFrame([([0.0] * 10 + [5.0] + [0.0] * 9, [3, 12])], "x array<double>, p array<int>")
    x, p = F.col("x"), F.col("p")
    got = df.select(segments.add_peak(x, p, F.lit(8), 4), segments.snap_peak(x, p, F.lit(12), 4), segments.remove_peaks(p, F.array(F.lit(3)))).first()
    assert list(got) == [[3, 10, 12], [3, 10], [12]]


def test_flags_and_the_blind_switch(spark):
    df = spark.createDataFrame([(False, "no", None)], "morphology_validated boolean, morphology_qc_passed string, x double")
    row = F.struct(*df.columns)
    ask = lambda *blind: df.select(quality.flag_reason(df.columns, blind)("morph_x", row)).first()[0]
    assert ask() == "morphology_validated=false" and ask("morphology_validated") == "morphology_qc_passed=false" and ask("morphology_validated", "morphology_qc_passed") == ""


def test_catalog_and_warnings(spark):
    rows = [{"column": "a", "role": "input"}, {"column": "a", "role": "target"}, {"column": "t", "role": "target", "operation_id": "o"}]
    got = dataset.catalog_table(spark, rows).collect()
    assert [(r.column, r.is_target) for r in got] == [("a", False), ("t", True)]
    assert len(dataset.dataset_warnings(["a", "a", "Unnamed: 3"], 2, 1, ["t"])) == 4 and dataset.dataset_warnings(["a"]) == []
    assert "| a |" in reports.markdown("T", {"n": 1}, ["w"], {"some_rows": spark.createDataFrame([(k,) for k in range(25)], "a int")}) and "No rows." in reports.markdown("T", {}, [], {"none": spark.createDataFrame([], "a int")})


def test_scope_and_leaks(spark):
    catalog = dataset.catalog_table(spark, [{"column": "raw_ecg__before__f", "role": "input", "source_table": "raw_ecg_features"}, {"column": "ecg_der__o__f", "role": "input", "source_table": "ecg_derived", "operation_id": "o"}, {"column": "ctx__x", "role": "input", "source_table": "context_computed"}, {"column": "target__t", "role": "target", "operation_id": "o"}])
    names = lambda **k: sorted(r.column for r in analysis.in_scope(catalog, **k).collect())
    assert names() == ["ecg_der__o__f", "raw_ecg__before__f"] and names(access="before") == ["raw_ecg__before__f"] and names(access="delta") == ["ecg_der__o__f"] and names(mode="manual", manual=("ctx__x",)) == ["ctx__x"]
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 1.0), (2.0, 2.0, 5.0, 2.0)], "raw_ecg__before__f double, ecg_der__o__f double, ctx__x double, target__t double")
    assert {(r.feature, r.why) for r in analysis.leaks(df, catalog, ["target__t"], {"target__t": ["ctx__x"]}).collect()} == {("raw_ecg__before__f", "equal"), ("ecg_der__o__f", "same_operation"), ("ctx__x", "forbidden")}
    links = spark.createDataFrame([("a", "b")], "a string, b string")
    assert analysis.representatives(links, spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.1)], "feature string, score double")) == {"b": "b", "a": "b", "c": "c"}


def test_stream_gives_what_batch_gives(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{data}/events.parquet").orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in" / "x"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    q = windows.write_by_day(windows.windowed(stream, ["event_type"], "6 hours", late="1 hour"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    whole = windows.windowed(spark.read.schema(schema).parquet(f"{data}/events.parquet"), ["event_type"], "6 hours")
    last = whole.agg(F.max("end")).first()[0]
    closed = whole.where(F.col("end") < F.lit(last) - F.expr("INTERVAL 7 HOURS"))
    assert closed.select("event_type", "start", "n").subtract(got.select("event_type", "start", "n")).count() == 0


def test_sketched_summary_is_close(spark, data):
    df = spark.read.parquet(f"{data}/events.parquet").select("value", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("some"))
    near = {r.column: r for r in reports.summarize(df, ["value", "some"], exact=False).collect()}
    for r in reports.summarize(df, ["value", "some"]).collect():
        a = near[r.column]
        assert (a.n_total, a.n_valid, a.min, a.max) == (r.n_total, r.n_valid, r.min, r.max) and a.mean == pytest.approx(r.mean)
        assert a.median == pytest.approx(r.median, rel=0.02) and a.iqr == pytest.approx(r.iqr, rel=0.05) and a.n_unique == pytest.approx(r.n_unique, rel=0.05)
