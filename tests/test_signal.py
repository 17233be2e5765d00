"""The signal layer on synthetic recordings with known beats."""

import numpy as np
import pytest

from sigloom.plans.protocol import morphology_limits, signal_limits
from sigloom.signal import filters, hrv, morphology, peaks, record, synthetic

FS = 234.45


def found(x, truth, tolerance=3):
    at = peaks.detect_r_peaks(filters.bandpass(x, FS, 0.5, 30), FS)
    inside = truth[(truth > FS * 0.5) & (truth < len(x) - FS * 0.5)]
    hit = [np.abs(at - t).min() <= tolerance for t in inside] if len(at) else [False] * len(inside)
    return at, float(np.mean(hit))


@pytest.mark.parametrize("how", [{}, {"noise": 8.0}, {"wander": 40.0}, {"hr": 50.0}, {"hr": 120.0}, {"inverted": True}])
def test_peaks(how):
    for seed in range(3):
        x, truth = synthetic.recording(60, seed, **how)
        at, recall = found(x, truth)
        assert recall >= 0.98 and abs(len(at) - len(truth)) <= 2


def test_no_peaks_in_nothing():
    assert len(peaks.detect_r_peaks(np.zeros(3000), FS)) == 0
    assert len(peaks.detect_r_peaks(np.zeros(20), FS)) == 0


def test_bandpass_keeps_the_middle_and_drops_the_rest():
    t = np.arange(6000) / FS
    gain = lambda f: filters.bandpass(np.sin(2 * np.pi * f * t), FS, 0.5, 30)[1500:-1500].std() * np.sqrt(2)
    assert gain(8) == pytest.approx(1, abs=0.02) and gain(0.05) < 0.03 and gain(90) < 0.05
    assert gain(0.5) == pytest.approx(0.5, abs=0.05)  # -3 dB twice


def test_savitzky_golay_keeps_cubics():
    x = np.arange(50.0)
    y = 2 + x - 0.3 * x**2 + 0.01 * x**3
    assert np.allclose(filters.savitzky_golay(y, 7), y)


def test_welch_is_a_density():
    x = np.random.default_rng(0).standard_normal(4096)
    f, p = hrv.welch(x, 4.0)
    assert np.trapezoid(p, f) == pytest.approx(x.var(), rel=0.1)


def test_interval_features():
    rr = 0.8 + 0.05 * np.sin(2 * np.pi * 0.1 * np.cumsum(np.full(400, 0.8)))
    f = hrv.frequency_domain(rr)
    assert f["LF_peak_Hz"] == pytest.approx(0.1, abs=0.02) and f["LF_power"] > 20 * f["HF_power"]
    assert hrv.time_domain(rr[:2])["n_rr"] == 2 and np.isnan(hrv.time_domain(rr[:2])["MeanNN_ms"])
    noise = np.random.default_rng(1).standard_normal(600)
    a1, _ = hrv.dfa(noise)
    assert a1 == pytest.approx(0.5, abs=0.15)
    assert np.isnan(hrv.dfa(noise[:10])[0]) and np.isnan(hrv.higuchi_dimension(noise[:10])) and np.isnan(hrv.sample_entropy(noise[:3]))
    assert hrv.sample_entropy(noise) > hrv.sample_entropy(np.sin(np.arange(600) / 5))


def test_sample_entropy_by_pairs():
    x = np.random.default_rng(2).standard_normal(40)
    r = 0.2 * x.std()
    n = {}
    for m in (2, 3):
        t = [x[i : i + m] for i in range(len(x) - m + 1)]
        n[m] = sum(np.abs(t[i] - t[j]).max() <= r for i in range(len(t)) for j in range(i + 1, len(t)))
    assert hrv.sample_entropy(x) == pytest.approx(-np.log(n[3] / n[2])) if n[3] else True


def test_shape_of_a_beat():
    x, truth = synthetic.recording(30, 5, noise=0.5)
    waves, q = record.shape(x, truth[2:-2], FS, 0.8)
    assert q["n_beats_good"] == q["n_beats_extracted"] > 20
    qrs = waves["qrs"]
    assert 40 < qrs["QRS_duration_ms"] < 140 and not qrs["QRS_inverted_for_analysis"] and qrs["Q_idx"] < qrs["R_idx"] < qrs["S_idx"]
    assert waves["p"]["P_present"] and waves["t"]["T_present"] and waves["t"]["T_polarity"] == "positive"
    assert waves["p"]["PR_peak_interval_ms"] == pytest.approx(130, abs=15) and waves["t"]["RT_interval_ms"] == pytest.approx(220, abs=20)
    turned, _ = record.shape(680 - x, truth[2:-2], FS, 0.8)
    assert turned["qrs"]["QRS_inverted_for_analysis"] and turned["qrs"]["QRS_polarity_raw"] == "negative"
    assert morphology.wave_features(None, FS) == {"qrs": {}, "p": {}, "t": {}}


PROFILE = {"expected_hr_bpm": {"min": 40, "max": 130}, "morphology": {"enabled": True, "expected_qrs_duration_ms": {"min": 40, "max": 140}}}


def plan(**more):
    return {"signal_limits": signal_limits(PROFILE), "morphology_limits": morphology_limits(PROFILE), "feature_groups": ["hrv_time", "hrv_extended", "morphology"], "corr_threshold": 0.8, "review_scope": "record", "segmentation": {"mode": "full"}} | more


def test_record():
    x, truth = synthetic.recording(60, 3, hr=72)
    (row,) = record.process(x, FS, plan())
    assert row["hrv_validated"] and row["morphology_validated"] and row["hrv_time__MeanHR_bpm"] == pytest.approx(72, rel=0.05)
    rr = np.diff(truth) / FS
    assert row["hrv_time__MeanNN_ms"] == pytest.approx(rr.mean() * 1000, rel=0.02)


def test_record_segments_and_bad_signals():
    x, _ = synthetic.recording(60, 3, hr=72)
    cut = {"mode": "fixed_windows", "window_sec": 20.0, "step_sec": 20.0, "min_window_sec": 10.0}
    rows = record.process(x, FS, plan(segmentation=cut, review_scope="segment"))
    assert [(r["window_idx"], r["start_sec"]) for r in rows] == [(1, 0.0), (2, 20.0), (3, 40.0)]
    assert record.process(np.zeros(5000), FS, plan()) == [] and record.process(x[:100], FS, plan()) == []
    noise = np.random.default_rng(0).uniform(0, 675, 8000)
    for r in record.process(noise, FS, plan()):
        assert not r["hrv_validated"] and r["hrv_time__MeanNN_ms"] is None and r["hrv_qc_reasons"]


def test_review_modes():
    """auto decides by the gates, bad_only asks where one fails, manual always; a review settles it, with its peaks."""
    x, truth = synthetic.recording(60, 3, hr=72)
    noise = np.random.default_rng(0).uniform(0, 675, 8000)
    status = lambda signal, mode, said=None: [(r["hrv_review_status"], r["hrv_review_source"], r["hrv_validated"], r["hrv_time__MeanNN_ms"] is not None) for r in record.process(signal, FS, plan(review_mode=mode), said)]
    assert status(x, "auto") == status(x, "bad_only") == status(x, "none") == [("accepted", "auto", True, True)]
    assert status(x, "manual") == status(x, "whatever") == [("pending", "manual", False, False)]
    assert status(noise, "auto") == [("skipped", "auto", False, False)] and status(noise, "bad_only") == [("pending", "manual", False, False)]
    yes = {"full": {"hrv_review_status": "accepted", "hrv_qc_passed": True, "rpeaks": list(range(100, 7900, 150))}}
    for mode in ("bad_only", "manual", "auto"):
        assert status(noise, mode, yes) == [("accepted", "manual", True, True)]
    (row,) = record.process(noise, FS, plan(review_mode="manual"), yes)
    assert row["hrv_time__MeanNN_ms"] == pytest.approx(150 / FS * 1000) and row["morphology_review_status"] == "pending"
    assert status(x, "manual", {"full": {"hrv_review_status": "skipped", "hrv_qc_passed": False}}) == [("skipped", "manual_skipped", False, False)]


def test_suspicious():
    at = np.array([200, 400, 600, 680, 1000, 1200, 1400, 1600])
    odd = peaks.suspicious(2000, at, 200.0)
    assert odd.tolist() == [False, False, True, True, True, False, False, False]
    assert peaks.amplitude_qc(np.zeros(100), np.array([50]), 100.0)["rpeak_amp_bad_ratio"] == 1.0
