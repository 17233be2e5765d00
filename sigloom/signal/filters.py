"""Zero-phase Butterworth filters and Savitzky-Golay smoothing."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def butter_bandpass(order: int, low: float, high: float, fs: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a digital Butterworth band-pass, by the bilinear transform of its poles."""
    w1, w2 = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    width, center = w2 - w1, np.sqrt(w1 * w2)
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    half = proto * width / 2
    root = np.sqrt(half**2 - center**2)
    poles = np.concatenate([half + root, half - root])
    z = (2 * fs + poles) / (2 * fs - poles)
    mid = np.exp(2j * np.arctan(center / (2 * fs)))
    sections = []
    pairs = z[z.imag > 1e-12]
    real = np.sort(z[np.abs(z.imag) <= 1e-12].real)
    for p in pairs:
        sections.append(np.array([1.0, -2 * p.real, abs(p) ** 2]))
    for p, q in zip(real[::2], real[1::2], strict=True):
        sections.append(np.array([1.0, -(p + q), p * q]))
    out = []
    for a in sections:
        b = np.array([1.0, 0.0, -1.0])  # zeros at 0 Hz and at half the sampling rate
        gain = abs(np.polyval(b, mid) / np.polyval(a, mid))
        out.append((b / gain, a))
    return out


def power_response(sections: list[tuple[np.ndarray, np.ndarray]], f: np.ndarray, fs: float) -> np.ndarray:
    """The squared gain at the frequencies f: what a pass forwards and one backwards do together, without phase."""
    z = np.exp(-2j * np.pi * f / fs)
    gain = np.ones(len(f))
    for b, a in sections:
        gain *= np.abs((b[0] + z * (b[1] + z * b[2])) / (a[0] + z * (a[1] + z * a[2]))) ** 2
    return gain


@lru_cache(maxsize=4)  # recordings mostly share their rate and rounded length
def _gain(order: int, low: float, high: float, fs: float, size: int) -> np.ndarray:
    return power_response(butter_bandpass(order, low, high, fs), np.fft.rfftfreq(size, 1.0 / fs), fs)


def bandpass(x: np.ndarray, fs: float, low: float, high: float, order: int = 2) -> np.ndarray:
    """x filtered forwards and backwards. Its ends are mirrored at the edges against transients, and both passes are made
    at once in the frequency domain."""
    x = np.asarray(x, float)
    pad = min(len(x) - 1, int(3 * fs / max(low, 1e-3) / 2))
    if pad < 1:
        return x - x.mean() if len(x) else x
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    size = 1 << (len(y) + pad - 1).bit_length()  # room for the tails, so that they do not wrap into the signal
    return np.fft.irfft(np.fft.rfft(y, size) * _gain(order, low, high, fs, size), size)[pad : pad + len(x)]


def savitzky_golay(x: np.ndarray, window: int, degree: int = 3) -> np.ndarray:
    """Least-squares polynomials over odd windows; the ends take the values of the first and the last fit."""
    half = window // 2
    t = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(t, degree + 1, increasing=True))
    out = np.convolve(x, fit[0][::-1], mode="same")
    powers = np.vander(t, degree + 1, increasing=True)
    out[:half] = (powers @ (fit @ x[:window]))[:half]
    out[-half:] = (powers @ (fit @ x[-window:]))[-half:]
    return out
