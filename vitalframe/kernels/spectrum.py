"""Power spectra and the features taken from them."""

from __future__ import annotations

import numpy as np

EPS = 1e-12
SPECTRAL = ("E1_norm", "E2_norm", "harmonic_ratio", "spectral_centroid", "spectral_entropy", "MAX_POWER_1st", "F_MAX_1st", "MAX_POWER_2nd", "F_MAX_2nd", "MEAN_PSD", "STD_PSD", "VAR_PSD", "KUR_PSD")


def welch(x: np.ndarray, fs: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """Averaged one-sided power density of half-overlapping Hann segments, each without its mean."""
    x = np.asarray(x, float)
    nperseg = min(nperseg, len(x))
    step = nperseg - nperseg // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    parts = np.lib.stride_tricks.sliding_window_view(x, nperseg)[::step]
    power = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * window)) ** 2 / (fs * (window**2).sum())
    power[:, 1 : (nperseg + 1) // 2] *= 2
    return np.fft.rfftfreq(nperseg, 1 / fs), power.mean(0)


def band_energy(f: np.ndarray, p: np.ndarray, low: float, high: float) -> float:
    """Trapezoid over the inclusive band; NaN if it is empty."""
    inside = (f >= low) & (f <= high)
    return float(np.trapezoid(p[inside], f[inside])) if inside.any() else np.nan


def kurtosis_unbiased(x: np.ndarray) -> float:
    n, c = len(x), x - x.mean()
    m2 = (c**2).mean()
    if n < 4 or m2 == 0:
        return np.nan
    return float(((n + 1) * ((c**4).mean() / m2**2 - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def spectral_features(x: np.ndarray, fs: float) -> dict[str, float]:
    """Fundamental and second harmonic, shape and moments of the spectrum between 0.5 and 5 Hz. Raises on what has none."""
    x = np.asarray(x, float)
    if x.ndim != 1 or len(x) < 3 or not np.isfinite(x).all():
        raise ValueError("a finite one-dimensional signal is needed")
    nperseg = min(len(x), max(int(5 * fs / 0.7), int(fs / 0.05)))
    if nperseg < 8:
        raise ValueError("the signal is too short")
    f, p = welch(x - x.mean(), fs, nperseg)
    band, pulse = (f >= 0.5) & (f <= 5.0), (f >= 0.6) & (f <= 3.0)
    if not band.any() or not pulse.any():
        raise ValueError("no spectral lines in the band")
    fb, pb = f[band], p[band]
    first = np.flatnonzero(pulse)[np.argmax(p[pulse])]
    f0 = f[first]
    second = np.flatnonzero((f >= 1.8 * f0) & (f <= 2.2 * f0))
    top = second[np.argmax(p[second])] if len(second) else None
    total = np.trapezoid(pb, fb) + EPS
    e1, e2 = band_energy(f, p, 0.9 * f0, 1.1 * f0), band_energy(f, p, 1.8 * f0, 2.2 * f0)
    share = pb / (pb.sum() + EPS)
    values = (
        e1 / total, e2 / total, e2 / (e1 + EPS), float((fb * pb).sum() / (pb.sum() + EPS)), float(-(share * np.log(share + EPS)).sum() / np.log(len(share))) if len(share) > 1 else np.nan,
        float(p[first]), float(f0), float(p[top]) if top is not None else np.nan, float(f[top]) if top is not None else np.nan,
        float(pb.mean()), float(pb.std()), float(pb.var()), kurtosis_unbiased(np.log10(pb + EPS)))
    return dict(zip(SPECTRAL, map(float, values)))


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal: negative frequencies removed, positive ones doubled."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)
