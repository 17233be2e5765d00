"""Edit logs: every verb, refusals, order, and the way from a log to a decision."""

from __future__ import annotations

import numpy as np
import pytest

from sigloom.operators import edits as over_rows
from sigloom.plans.protocol import morphology_limits
from sigloom.signal import edits, record, synthetic
from sigloom.sources import tables

FS = 234.45
LIMITS = morphology_limits({"expected_hr_bpm": {"min": 40, "max": 130}, "morphology": {"enabled": True, "expected_qrs_duration_ms": {"min": 40, "max": 140}}})


@pytest.fixture(scope="module")
def signal():
    return np.asarray(synthetic.recording(60, 1)[0], float)


def after(signal, *log):
    state = edits.SignalEdits(signal, FS)
    return edits.replay(state, list(log)), state


def test_ends(signal):
    first = record.detected(signal, FS)[1]
    out, _ = after(signal, "OK", "remove_last")
    assert out["status"] == "accepted" and out["rpeaks"] == first.tolist() and [x["step"] for x in out["log"]] == ["ok"]
    assert out["signal"] == signal.tolist() and set(out["rpeaks_no_edge"]) <= set(out["rpeaks"])
    out, _ = after(signal, "skip")
    assert (out["status"], out["signal"], out["rpeaks"], out["rpeaks_no_edge"]) == ("skipped", None, None, None) and out["qc"]["n_rpeaks"] == len(first)
    assert after(signal, "", "n")[0]["status"] == "pending"


def test_views_move_within_the_recording(signal):
    for log, start, window in [(["n"], 15, 15), (["n"] * 9, 45, 15), (["n", "p", "p"], 0, 15), (["goto 20"], 20, 15), (["goto 99"], 45, 15), (["goto -3"], 0, 15), (["goto 50", "win 30"], 30, 30), (["win 90"], 0, 90)]:
        state = after(signal, *log)[1]
        assert (round(state.start, 1), state.window) == (start, window), log


def test_peaks_by_their_numbers(signal):
    first = record.detected(signal, FS)[1]
    assert after(signal, "remove_last", "remove_last")[0]["rpeaks"] == first[:-2].tolist()
    view = [p for p in first if round(20 * FS) <= p < round(35 * FS)]
    assert after(signal, "goto 20", "removev 1 3 99")[0]["rpeaks"] == [p for p in first if p not in (view[0], view[2])]
    assert after(signal, "goto 20")[1].visible() == dict(enumerate(view, 1))
    gone = after(signal, "goto 20", "removev 2", f"add {view[1] / FS}", "add 0 5")[0]["rpeaks"]
    x = record.detected(signal, FS)[0]
    back = edits.extremum(x, round(view[1] / FS * FS), 10)
    assert back in gone and set(first) - {view[1]} <= set(gone) and len(gone) == len(first) + 1
    snapped = after(signal, "goto 20", "snapv 2 30")[0]["rpeaks"]
    assert snapped == sorted({*first} - {view[1]} | {edits.extremum(x, view[1], 30)})
    assert after(signal, "add 1e9")[0]["rpeaks"][-1] >= len(x) - 11


def test_crop_and_recompute_detect_anew(signal):
    out, _ = after(signal, "remove_last", "crop 10 40", "ok")
    part = signal[round(10 * FS) : round(40 * FS)]
    assert out["signal"] == part.tolist() and out["rpeaks"] == record.detected(part, FS)[1].tolist()
    again, _ = after(signal, "remove_last", "recompute")
    assert again["rpeaks"] == record.detected(signal, FS)[1].tolist()
    twice, _ = after(signal, "crop 10 40", "crop 5 10")
    assert twice["signal"] == part[round(5 * FS) : round(10 * FS)].tolist()


def test_bad_windows(signal):
    at = record.detected(signal, FS)[1]
    holes = [f"goto {t}" if k == 0 else "removev 5" for t in (10, 40) for k in (0, 1)]
    state = after(signal, *holes, "goto 0")[1]
    starts = state.suspicious()
    assert len(starts) >= 2 and all(b - a > state.window / 2 for a, b in zip(starts, starts[1:], strict=False))
    state = after(signal, *holes, "goto 0", "badnext")[1]
    assert state.start == [w for w in starts if w > 0][0]
    out, state = after(signal, *holes, "badlist", "peaks", "help", *["badnext"] * 40)
    assert ("badlist", f"n_windows={len(starts)}") in state.log and out["log"][-1]["step"] == "refused" and len(at) - 2 == len(state.at)


@pytest.mark.parametrize("edit", ["goto", "goto x", "win 1", "win nan", "crop 5", "crop 9 3", "crop a b", "crop 70 80", "removev", "removev 1.5", "snapv", "snapv 99", "snapv 1 2 3", "add", "add x", "fly", "corr 0.5"])
def test_what_cannot_be_done_changes_nothing(signal, edit):
    out, state = after(signal, edit)
    plain = edits.SignalEdits(signal, FS)
    assert out["rpeaks"] == plain.at.tolist() and (state.start, state.window, len(state.x)) == (plain.start, plain.window, len(plain.x))
    assert [x["step"] for x in out["log"]] == ["refused"] and out["status"] == "pending"


def test_shapes(signal):
    at = record.detected(signal, FS)[1]
    out = edits.replay(edits.ShapeEdits(signal, at, FS, 0.8, LIMITS), ["help", "corr 2", "corr 0.999999", "recompute", "ok", "corr 0.1"])
    assert out["status"] == "accepted" and out["corr_threshold"] == 0.999999 and [x["step"] for x in out["log"]] == ["help", "refused", "corr", "recompute", "ok"]
    assert out["qc_gate"]["passed"] is False and out["qc_gate"]["reasons"]
    fine = edits.replay(edits.ShapeEdits(signal, at, FS, 0.8, LIMITS), ["skip"])
    assert fine["status"] == "skipped" and fine["qc_gate"]["passed"] and fine["error"] is None


def test_every_verb_is_there():
    assert all(callable(getattr(edits.SignalEdits, v)) for v in edits.SIGNAL_VERBS) and all(callable(getattr(edits.ShapeEdits, v)) for v in edits.SHAPE_VERBS)


def test_logs_over_rows(spark, tmp_path, signal):
    key = ("01.01.2026", "before", "sit", "full")
    other = ("02.01.2026", *key[1:])
    third = ("03.01.2026", *key[1:])
    recordings = spark.createDataFrame([(*key, signal.tolist(), FS), (*other, signal.tolist(), FS), (*third, signal.tolist(), FS), ("04.01.2026", *key[1:], [], FS)], "date string, phase string, record_type string, segment_label string, signal array<double>, fs double")
    log = [(*key, "signal", 3, "ok"), (*key, "signal", 1, "goto 20"), (*key, "signal", 2, "removev 1"), (*key, "morphology", 1, "corr 0.5"), (*key, "morphology", 2, "ok"), (*other, "signal", 1, "skip"), (*other, "morphology", 1, "ok"), ("09.01.2026", *key[1:], "signal", 1, "ok"), ("04.01.2026", *key[1:], "signal", 1, "ok")]
    edited = spark.createDataFrame(log, "date string, phase string, record_type string, segment_label string, part string, seq int, edit string").repartition(5)
    reviews = over_rows.replayed(recordings, edited, LIMITS)
    tables.write_reviews(reviews, str(tmp_path / "reviews"))
    got = {r.date: r for r in tables.decisions(tables.read_reviews(spark, str(tmp_path / "reviews"), lines=True)).collect()}
    assert set(got) == {"01.01.2026", "02.01.2026", "04.01.2026"}
    want = after(signal, "goto 20", "removev 1", "ok")[0]
    assert got["01.01.2026"].rpeaks == want["rpeaks"] and (got["01.01.2026"].signal_review_status, got["01.01.2026"].morphology_review_status, got["01.01.2026"].morphology_qc_passed) == ("accepted", "accepted", True)
    assert got["02.01.2026"].signal_review_status == "skipped" and got["02.01.2026"].rpeaks is None and got["02.01.2026"].morphology_review_status is None
    assert got["04.01.2026"].signal_review_status is None
