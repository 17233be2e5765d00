"""Detection of R peaks, and checks of peaks."""

from __future__ import annotations

import numpy as np

NAN = float("nan")


def _smooth(x: np.ndarray, n: int) -> np.ndarray:
    n = max(1, n)
    total = np.cumsum(np.concatenate([np.zeros(n // 2 + 1), x, np.zeros(n - n // 2 - 1)]))
    return (total[n:] - total[:-n]) / n


SHORT_SEC, LONG_SEC, DELAY_SEC = 0.1, 0.75, 0.3
#: Of the mean length of steep regions, what a QRS complex has at least.
LEAST_SHARE = 0.4


def steep_regions(x: np.ndarray, fs: float, short_sec: float = SHORT_SEC, long_sec: float = LONG_SEC) -> tuple[np.ndarray, np.ndarray]:
    """Where the smoothed gradient is above 1.5 times its average over a longer window: starts and ends."""
    steep = np.abs(np.gradient(x))
    fine = _smooth(steep, int(round(short_sec * fs)))
    above = fine > 1.5 * _smooth(fine, int(round(long_sec * fs)))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], above.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _median(x: np.ndarray) -> float:
    """np.median() of a row; for the few samples around a beat that takes several times as long."""
    if not len(x):
        return np.nan
    y, half = np.sort(x), len(x) // 2
    return np.nan if np.isnan(y[-1]) else y[half] if len(x) % 2 else (y[half - 1] + y[half]) / 2


def peak_in(x: np.ndarray, start: int, end: int, fs: float) -> int:
    """The greatest sample of a region over the median around it, or the least where the beats point down."""
    part = x[start:end] - _median(x[max(0, start - int(fs / 4)) : end + int(fs / 4)])
    return start + int(np.argmax(part if part.max() >= 0.6 * -part.min() else -part))


def long_enough(n: int, fs: float, long_sec: float = LONG_SEC) -> bool:
    return n >= int(fs * long_sec) + 2


def detect_r_peaks(x: np.ndarray, fs: float, short_sec: float = SHORT_SEC, long_sec: float = LONG_SEC, min_delay_sec: float = DELAY_SEC) -> np.ndarray:
    """Peaks where the steepness of the signal stands out from its surroundings (filtered signal in, indices out).

    A steep region is a QRS complex if it has at least 0.4 of the mean length of such regions; its greatest sample is the
    peak. Later peaks within min_delay are dropped.
    """
    if not long_enough(len(x), fs, long_sec):
        return np.zeros(0, int)
    starts, ends = steep_regions(x, fs, short_sec, long_sec)
    if not len(starts):
        return np.zeros(0, int)
    least = LEAST_SHARE * (ends - starts).mean()
    out, last = [], -np.inf
    for s, e in zip(starts, ends, strict=True):
        if e - s < least:
            continue
        peak = peak_in(x, s, e, fs)
        if peak - last > min_delay_sec * fs:
            out.append(peak)
            last = peak
    return np.array(out, int)


def without_edge(peaks: np.ndarray, n: int, fs: float, guard_sec: float = 0.5) -> np.ndarray:
    guard = round(guard_sec * fs)
    return peaks[(peaks >= guard) & (peaks < n - guard)]


def basic_qc(x: np.ndarray, peaks: np.ndarray, fs: float, adc: tuple[float, float] = (0, 675), rr: tuple[float, float] = (0.3, 2.0)) -> dict[str, float]:
    gaps = np.diff(peaks) / fs
    return {
        "clipping_ratio": float((x <= adc[0] + 2).mean() + (x >= adc[1] - 2).mean()) if len(x) else NAN,
        "rr_phys_bad_ratio": float(((gaps < rr[0]) | (gaps > rr[1])).mean()) if len(gaps) else NAN,
        "n_rpeaks": len(peaks),
        "mean_hr_bpm_rough": float(60.0 / gaps.mean()) if len(gaps) else NAN,
    }


def suspicious(n: int, peaks: np.ndarray, fs: float, guard_sec: float = 0.5, rr: tuple[float, float] = (0.35, 2.0), ratio: tuple[float, float] = (0.70, 1.50)) -> np.ndarray:
    """Which peaks are near an edge, or end an interval that is out of bounds or unlike the median of the five around it."""
    guard = round(guard_sec * fs)
    out = (peaks < guard) | (peaks >= n - guard)
    gaps = np.diff(peaks) / fs
    if len(gaps):
        padded = np.concatenate([[np.nan] * 2, gaps, [np.nan] * 2])
        mid = np.nanmedian(np.lib.stride_tricks.sliding_window_view(padded, 5), axis=1)
        bad = (gaps < rr[0]) | (gaps > rr[1]) | ((mid > 1e-9) & ((gaps < ratio[0] * mid) | (gaps > ratio[1] * mid)))
        out[:-1] |= bad
        out[1:] |= bad
    return out


def amplitude_qc(x: np.ndarray, peaks: np.ndarray, fs: float, ratio: tuple[float, float] = (0.40, 2.50), least: float | None = None, around_sec: float = 0.2) -> dict[str, float | bool]:
    """How alike the peaks are in height over the median around them."""
    peaks = peaks[(peaks >= 0) & (peaks < len(x))]
    radius = max(1, round(around_sec * fs))
    heights = np.array([abs(x[p] - _median(x[max(0, p - radius) : p + radius + 1])) for p in peaks])
    out: dict[str, float | bool] = {f"rpeak_amp_{k}": NAN for k in ("median", "min", "max", "bad_ratio", "too_low_ratio", "too_high_ratio")}
    out["rpeak_amp_global_too_low"] = False
    if not len(heights):
        return out
    mid = float(np.median(heights))
    out |= {"rpeak_amp_median": mid, "rpeak_amp_min": float(heights.min()), "rpeak_amp_max": float(heights.max()), "rpeak_amp_bad_ratio": 1.0}
    if mid > 1e-12:
        low, high = heights / mid < ratio[0], heights / mid > ratio[1]
        out |= {"rpeak_amp_too_low_ratio": float(low.mean()), "rpeak_amp_too_high_ratio": float(high.mean()), "rpeak_amp_bad_ratio": float((low | high).mean())}
    out["rpeak_amp_global_too_low"] = least is not None and mid < least
    return out
