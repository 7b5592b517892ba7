"""Peaks, beats and pulses of waveforms."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from vitalframe.kernels import filters


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Samples above both neighbours; of a plateau the middle one. Ends never count."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.zeros(0, int)
    if not (x[1:] == x[:-1]).any():  # no plateau
        rises = x[1:] > x[:-1]
        return np.flatnonzero(rises[:-1] & (x[1:-1] > x[2:])) + 1
    begins = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    ends = np.append(begins[1:], len(x)) - 1
    level = x[begins]
    up = np.concatenate([[False], level[1:] > level[:-1]])
    down = np.concatenate([level[:-1] > level[1:], [False]])
    return ((begins + ends) // 2)[up & down]


def prominence(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak over the higher of the two lowest points that separate it from higher ground."""
    out = np.empty(len(peaks))
    for k, p in enumerate(peaks.tolist()):
        higher = np.flatnonzero(x[:p] > x[p])
        left = x[higher[-1] + 1 if len(higher) else 0 : p + 1].min()
        higher = np.flatnonzero(x[p + 1 :] > x[p])
        right = x[p : p + 1 + higher[0] if len(higher) else len(x)].min()
        out[k] = x[p] - max(left, right)
    return out


def find_peaks(x: np.ndarray, height: float | None = None, distance: int = 1, least_prominence: float | None = None) -> np.ndarray:
    """Local maxima of a least height; of peaks closer than `distance` the higher stays; then of a least prominence."""
    x = np.asarray(x, float)
    peaks = local_maxima(x)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance > 1 and len(peaks):
        keep = np.ones(len(peaks), bool)
        for k in np.argsort(x[peaks], kind="stable")[::-1].tolist():
            if keep[k]:
                near = np.abs(peaks - peaks[k]) < distance
                near[k] = False
                keep &= ~near
        peaks = peaks[keep]
    if least_prominence is not None and len(peaks):
        peaks = peaks[prominence(x, peaks) >= least_prominence]
    return peaks


def robust_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """Peaks over the median: prominence of half the median deviation, 0.3 s apart."""
    x = np.asarray(x, float) - np.median(x)
    return find_peaks(x, distance=max(1, int(0.3 * fs)), least_prominence=max(0.5 * float(np.median(np.abs(x - np.median(x)))), 1e-6))


def systolic_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """Systolic peaks by two moving averages (Elgendi et al., 2013): blocks where the short average of the squared
    positive band-passed signal exceeds the beat average; wide enough blocks give their maximum, 0.3 s apart."""
    return _systolic(np.asarray(x, float).tobytes(), fs)[0].copy()


def pulse_clean(x: np.ndarray, fs: float) -> np.ndarray:
    """The band-passed signal that systolic peaks are found in."""
    return _systolic(np.asarray(x, float).tobytes(), fs)[1].copy()


@lru_cache(maxsize=4)
def _systolic(wave: bytes, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Systolic peaks and the cleaned signal; the groups of features ask for those of one wave in turn."""
    clean = filters.bandpass(np.frombuffer(wave), fs, 0.5, 8.0, 3)
    energy = np.clip(clean, 0, None) ** 2
    short, beat = max(1, round(0.111 * fs)), max(1, round(0.667 * fs))
    blocks = filters.moving_average(energy, short) > filters.moving_average(energy, beat) + 0.02 * energy.mean()
    edges = np.flatnonzero(np.diff(np.concatenate([[0], blocks.astype(int), [0]])))
    peaks: list[int] = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a < short:
            continue
        inside = find_peaks(clean[a:b])
        p = a + int(inside[np.argmax(clean[a:b][inside])] if len(inside) else np.argmax(clean[a:b]))
        if not peaks or p - peaks[-1] > 0.3 * fs:
            peaks.append(p)
    return np.array(peaks, int), clean


def r_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """R peaks from the smoothed absolute gradient against its longer average; the most prominent point of each block."""
    clean = filters.highpass(x, fs, 0.5, 5)
    steep = np.abs(np.gradient(clean))
    smooth = filters.moving_average(steep, max(1, round(0.1 * fs)))
    blocks = smooth > 1.5 * filters.moving_average(smooth, max(1, round(0.75 * fs)))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], blocks.astype(int), [0]])))
    widths = edges[1::2] - edges[::2]
    least = 0.4 * widths.mean() if len(widths) else 0
    peaks: list[int] = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        p = a + int(np.argmax(clean[a:b]))
        if b - a >= least and (not peaks or p - peaks[-1] > 0.3 * fs):
            peaks.append(p)
    return np.array(peaks, int)


def beats(x: np.ndarray, fs: float, peaks: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(onset, peak, next onset): onsets are the minima between peaks; a peak without an onset on both sides is left out."""
    peaks = systolic_peaks(x, fs) if peaks is None else peaks
    onsets = [a + int(np.argmin(x[a:b])) for a, b in zip(peaks[:-1].tolist(), peaks[1:].tolist())]
    return [(onsets[i - 1], int(peaks[i]), onsets[i]) for i in range(1, len(peaks) - 1)]
