"""Synthetic recordings with known beats: sums of bumps for the P, Q, R, S and T waves."""

from __future__ import annotations

import numpy as np

#: Wave: (offset from R in s, height, width in s).
WAVES = {"P": (-0.13, 0.10, 0.018), "Q": (-0.028, -0.10, 0.009), "R": (0.0, 1.0, 0.011), "S": (0.028, -0.18, 0.010), "T": (0.22, 0.22, 0.035)}


def recording(seconds: float, seed: int, fs: float = 234.45, hr: float = 70.0, noise: float = 1.0, wander: float = 5.0, inverted: bool = False, base: float = 340.0, height: float = 150.0) -> tuple[np.ndarray, np.ndarray]:
    """(samples, R peaks): whole numbers from 0 to 675."""
    rng = np.random.default_rng(seed)
    gaps = 60.0 / hr * (1 + 0.05 * np.sin(np.arange(int(seconds * hr / 60) + 3) * 0.7) + 0.02 * rng.standard_normal(int(seconds * hr / 60) + 3))
    beats = 0.4 + np.cumsum(gaps) - gaps[0]
    t = np.arange(int(seconds * fs)) / fs
    x = np.zeros_like(t)
    for at, top, width in WAVES.values():
        for b, lo, hi in zip(beats, np.searchsorted(t, beats + at - 6 * width), np.searchsorted(t, beats + at + 6 * width), strict=True):
            x[lo:hi] += top * np.exp(-0.5 * ((t[lo:hi] - b - at) / width) ** 2)
    x = base + (-height if inverted else height) * x + wander * np.sin(2 * np.pi * 0.2 * t) + noise * rng.standard_normal(len(t))
    peaks = np.round(beats * fs).astype(int)
    return np.clip(np.round(x), 0, 675), peaks[(peaks >= 0) & (peaks < len(t))]
