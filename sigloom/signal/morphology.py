"""The shape of beats: cutting, template correlation, and the waves of the median beat."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from sigloom.signal.filters import savitzky_golay

NAN = float("nan")
QRS_NAMES = (
    "QRS_main_idx R_idx Q_idx S_idx QRS_polarity_raw QRS_inverted_for_analysis QRS_main_amp Q_amp S_amp RS_amp QRS_onset_idx QRS_offset_idx QRS_duration_ms RQ_interval_ms RS_interval_ms R_width_half_ms"
    " QRS_width_ms QRS_width_20_ms QRS_left_width_ms QRS_right_width_ms QRS_area Positive_area Negative_area R_up_slope R_down_slope Noise_std Noise_dx_std QRS_amp_threshold QRS_dx_threshold"
).split()
P_NAMES = "P_present P_polarity P_amp P_width_ms PR_interval_ms PR_peak_interval_ms P_area P_onset_idx P_offset_idx P_peak_idx P_snr".split()
T_NAMES = "T_present T_polarity T_amp RT_interval_ms T_peak_interval_ms T_width_ms T_area T_onset_idx T_offset_idx T_peak_idx T_snr QT_like_ms".split()


def cut_beats(x: np.ndarray, peaks: np.ndarray, fs: float, pre_ms: float = 200, post_ms: float = 400) -> np.ndarray:
    """Beats x samples; beats that reach over an end are left out."""
    pre, post = int(pre_ms * fs / 1000), int(post_ms * fs / 1000)
    ok = peaks[(peaks >= pre) & (peaks + post < len(x))]
    return x[ok[:, None] + np.arange(-pre, post + 1)] if len(ok) else np.zeros((0, pre + post + 1))


def like_template(beats: np.ndarray, threshold: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """(the beats that are like the median beat, the correlation of each)."""
    if not len(beats):
        return beats, np.zeros(0)
    z = beats - beats.mean(axis=1, keepdims=True)
    sd = z.std(axis=1, keepdims=True)
    z = np.where(sd > 1e-9, z / np.where(sd > 1e-9, sd, 1.0), 0.0)
    t = np.median(z, axis=0)
    t = t - t.mean()
    size = np.sqrt((z * z).sum(axis=1) * (t * t).sum())
    r = np.divide(z @ t, size, out=np.full(len(z), NAN), where=size > 0)
    return beats[r >= threshold], r


def _samples(ms: float, fs: float) -> int:
    return round(ms * fs / 1000.0)


def _edge(n: int, fs: float, ms: float = 40) -> int:
    return min(max(3, _samples(ms, fs)), max(1, n // 4))


def level(x: np.ndarray, fs: float) -> np.ndarray:
    """x without the line between the means of its edges, around its median."""
    m = _edge(len(x), fs)
    y = x - np.linspace(x[:m].mean(), x[-m:].mean(), len(x))
    return y - np.median(y)


def edge_noise(x: np.ndarray, fs: float) -> tuple[float, float]:
    """Standard deviations of the edges of x and of its slope."""
    m = _edge(len(x), fs)
    ends = np.r_[0:m, len(x) - m : len(x)]
    return float(x[ends].std(ddof=1)), float((np.gradient(x) * fs)[ends].std(ddof=1))


def chord_area(x: np.ndarray, lo: int, hi: int, fs: float) -> float:
    part = x[lo : hi + 1]
    if hi <= lo or len(part) < 2:
        return NAN
    return float(np.trapezoid(part - np.linspace(part[0], part[-1], len(part)), dx=1.0 / fs))


def _reach(low: np.ndarray, peak: int, lo: int, hi: int) -> tuple[int, int]:
    """The nearest places on both sides of a peak where `low` holds, or the bounds."""
    left, right = np.flatnonzero(low[lo:peak]), np.flatnonzero(low[peak + 1 : hi + 1])
    return (lo + int(left[-1]) if len(left) else lo), (peak + 1 + int(right[0]) if len(right) else hi)


def width_at(x: np.ndarray, peak: int, fs: float, fraction: float) -> float:
    top = abs(x[peak])
    if top < 1e-12:
        return NAN
    left, right = _reach(np.abs(x) <= fraction * top, peak, 0, len(x) - 1)
    return float((right - left) / fs * 1000.0)


class Wave(NamedTuple):
    peak: int
    left: int
    right: int
    width_ms: float
    snr: float


def find_wave(x: np.ndarray, lo: int, hi: int, fs: float, noise: float, r_amp: float, least: float, widths: tuple[float, float]) -> Wave | None:
    """The greatest swing in [lo, hi) if it is high and neither too narrow nor too wide."""
    if hi - lo < 3 or len(x[lo:hi]) < 3:
        return None
    hi = min(hi, len(x))
    peak = lo + int(np.abs(x[lo:hi]).argmax())
    amp, noise = abs(x[peak]), max(noise, 1e-9)
    if amp < max(least * max(r_amp, 1e-9), 2.5 * noise):
        return None
    left, right = _reach(np.abs(x) <= max(0.20 * amp, 1.5 * noise), peak, lo, hi - 1)
    width = (right - left) / fs * 1000.0
    return Wave(peak, left, right, float(width), float(amp / noise)) if widths[0] <= width <= widths[1] else None


def qrs_bounds(x: np.ndarray, peak: int, fs: float, noise: float, noise_dx: float) -> tuple[int, int, float, float]:
    """(onset, offset, amplitude and slope thresholds): the first two quiet samples in a row on both sides."""
    dx = np.gradient(x) * fs
    near = _samples(40, fs)
    amp_limit = max(0.05 * max(x[peak], 0.0), 2.5 * noise)
    dx_limit = max(0.08 * float(np.abs(dx[max(0, peak - near) : peak + near + 1]).max()), 2.5 * noise_dx)
    quiet = (np.abs(x) <= amp_limit) & (np.abs(dx) <= dx_limit)
    pair = quiet[:-1] & quiet[1:]  # pair[k]: samples k and k + 1
    first, last = max(0, peak - _samples(120, fs)), min(len(x) - 1, peak + _samples(160, fs))
    before = np.flatnonzero(pair[first : max(first, peak - 1)])
    after = np.flatnonzero(pair[peak + 1 : last])
    onset = first + int(before[-1]) + 1 if len(before) else first
    offset = peak + 1 + int(after[0]) if len(after) else last
    if onset >= peak:
        onset = max(0, peak - near)
    if offset <= peak:
        offset = min(len(x) - 1, peak + _samples(60, fs))
    return onset, offset, float(amp_limit), float(dx_limit)


def _sign(v: float) -> str:
    return "positive" if v >= 0 else "negative"


def wave_features(beat: np.ndarray | None, fs: float, pre_ms: float = 200, search_ms: float = 60, smooth_ms: float = 15) -> dict[str, dict]:
    """The qrs, p and t features of a median beat; empty without a usable beat."""
    nothing: dict[str, dict] = {"qrs": {}, "p": {}, "t": {}}
    if beat is None or len(beat) < 10:
        return nothing
    x = level(np.asarray(beat, float), fs)
    window = max(5, _samples(smooth_ms, fs) | 1)
    if len(x) >= window:
        x = savitzky_golay(x, window)
    noise, noise_dx = edge_noise(x, fs)
    at, radius = _samples(pre_ms, fs), _samples(search_ms, fs)
    lo, hi = max(0, at - radius), min(len(x), at + radius + 1)
    if hi <= lo:
        return nothing
    r = lo + int(np.abs(x[lo:hi]).argmax())
    polarity, turned = _sign(x[r]), bool(x[r] < 0)
    x = -x if turned else x
    amp = float(x[r])
    on, off, amp_limit, dx_limit = qrs_bounds(x, r, fs, noise, noise_dx)
    ms = 1000.0 / fs
    dx = np.gradient(x) * fs
    q = on + int(x[on : r + 1].argmin()) if r > on else r
    s = r + int(x[r : off + 1].argmin()) if off > r else r
    s_amp = float(x[s]) if off > r else NAN
    body = x[on : off + 1]
    qrs = {
        "QRS_main_idx": r, "R_idx": r, "Q_idx": q, "S_idx": s, "QRS_polarity_raw": polarity, "QRS_inverted_for_analysis": turned,
        "QRS_main_amp": amp, "Q_amp": float(x[q]) if r > on else NAN, "S_amp": s_amp, "RS_amp": amp - s_amp,
        "QRS_onset_idx": on, "QRS_offset_idx": off, "QRS_duration_ms": (off - on) * ms, "RQ_interval_ms": (r - q) * ms, "RS_interval_ms": (s - r) * ms,
        "R_width_half_ms": width_at(x, r, fs, 0.5), "QRS_width_ms": (off - on) * ms, "QRS_width_20_ms": width_at(x, r, fs, 0.2), "QRS_left_width_ms": (r - on) * ms, "QRS_right_width_ms": (off - r) * ms,
        "QRS_area": chord_area(x, on, off, fs), "Positive_area": float(np.trapezoid(body.clip(min=0), dx=1 / fs)), "Negative_area": float(np.trapezoid(body.clip(max=0), dx=1 / fs)),
        "R_up_slope": float(dx[on : r + 1].max()) if r > on else NAN, "R_down_slope": float(dx[r : off + 1].min()) if off > r else NAN,
        "Noise_std": noise, "Noise_dx_std": noise_dx, "QRS_amp_threshold": amp_limit, "QRS_dx_threshold": dx_limit,
    }
    start = max(0, on - _samples(250, fs))
    p = find_wave(x, start, max(start + 3, on - _samples(40, fs)), fs, noise, amp, 0.03, (20, 180))
    t = find_wave(x, min(len(x) - 2, off + _samples(50, fs)), min(len(x), off + _samples(380, fs)), fs, noise, amp, 0.05, (40, 320))
    p_row: dict = {"P_present": p is not None}
    if p:
        p_row |= {"P_polarity": _sign(x[p.peak]), "P_amp": float(x[p.peak]), "P_width_ms": p.width_ms, "PR_interval_ms": (on - p.left) * ms, "PR_peak_interval_ms": (r - p.peak) * ms,
                  "P_area": chord_area(x, p.left, p.right, fs), "P_onset_idx": p.left, "P_offset_idx": p.right, "P_peak_idx": p.peak, "P_snr": p.snr}
    t_row: dict = {"T_present": t is not None}
    if t:
        t_row |= {"T_polarity": _sign(x[t.peak]), "T_amp": float(x[t.peak]), "RT_interval_ms": (t.peak - r) * ms, "T_peak_interval_ms": (t.peak - r) * ms, "T_width_ms": t.width_ms,
                  "T_area": chord_area(x, t.left, t.right, fs), "T_onset_idx": t.left, "T_offset_idx": t.right, "T_peak_idx": t.peak, "T_snr": t.snr, "QT_like_ms": (t.right - on) * ms}
    return {"qrs": qrs, "p": p_row, "t": t_row}
