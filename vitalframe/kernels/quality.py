"""Signal quality of pulse waveforms, per window and per sample."""

from __future__ import annotations

import numpy as np

from vitalframe.kernels import detector, filters, peaks as P, spectrum


def peak_score(n: int, seconds: float) -> float:
    """0 below three peaks, 0.2 outside 40 to 180 beats a minute, else the count against 1.2 beats a second."""
    if n < 3:
        return 0.0
    return min(1.0, n / (1.2 * seconds)) if 40 <= 60 * n / seconds <= 180 else 0.2


def rhythm_score(at: np.ndarray, fs: float) -> float:
    """exp(-5 cv) of the intervals between peaks."""
    gaps = np.diff(at) / fs
    return float(np.exp(-5 * gaps.std() / (gaps.mean() + 1e-12))) if len(gaps) >= 2 else 0.0


def line_score(f: np.ndarray, p: np.ndarray) -> float:
    """Share of the pulse band's power within a tenth of its strongest line."""
    band = np.flatnonzero((f >= 0.6) & (f <= 3.0))
    if not len(band):
        return 0.0
    f0 = f[band[np.argmax(p[band])]]
    return float(p[(f >= 0.9 * f0) & (f <= 1.1 * f0)].sum() / (p[band].sum() + 1e-12))


def noise_score(f: np.ndarray, p: np.ndarray) -> float:
    """1 - exp(-r), r the power of the pulse band over that of 5 to 15 Hz."""
    return float(1 - np.exp(-p[(f >= 0.6) & (f <= 3.0)].sum() / (p[(f >= 5.0) & (f <= 15.0)].sum() + 1e-12)))


def window_score(x: np.ndarray, fs: float, at: np.ndarray) -> float:
    """Weighted sum of the four components; of the spectral two alone with fewer than three peaks."""
    f, p = spectrum.welch(x, fs, min(len(x), int(8 * fs)))
    line, noise = line_score(f, p), noise_score(f, p)
    if len(at) < 3:
        return 0.6 * line + 0.4 * noise
    return 0.25 * peak_score(len(at), len(x) / fs) + 0.25 * rhythm_score(at, fs) + 0.3 * line + 0.2 * noise


def custom_quality(x: np.ndarray, fs: float, seconds: float = 8.0, hop: float = 1.0, smooth: bool = True) -> np.ndarray:
    """Quality per sample: window scores in Gaussian-weighted overlap-add, gaps interpolated, smoothed over half a second."""
    x = np.asarray(x, float)
    n, at = len(x), P.systolic_peaks(x, fs)
    width = int(seconds * fs)
    if width > n:
        width = min(n, max(int(0.8 * n), int(2 * fs)))
    weight = np.exp(-3 * np.linspace(-1, 1, width) ** 2)
    total, mass = np.zeros(n), np.zeros(n)
    for a in range(0, n - width + 1, max(1, int(hop * fs))):
        score = window_score(x[a : a + width], fs, at[(at >= a) & (at < a + width)] - a)
        total[a : a + width] += score * weight
        mass[a : a + width] += weight
    covered = np.flatnonzero(mass > 0)
    out = np.interp(np.arange(n), covered, total[covered] / mass[covered]) if len(covered) > 1 else np.zeros(n)
    return np.clip(filters.moving_average(out, int(0.5 * fs)) if smooth else out, 0, 1)


def template_quality(x: np.ndarray, fs: float) -> np.ndarray:
    """Quality per sample: each beat, from 0.3 s before to 0.4 s after its peak, is correlated with the mean beat; between
    peaks the correlations are joined by lines. Negative ones count 0."""
    x = np.asarray(x, float)
    at, before, after = P.systolic_peaks(x, fs), int(0.3 * fs), int(0.4 * fs)
    at = at[(at >= before) & (at + after <= len(x))]
    if len(at) < 2:
        return np.zeros(len(x))
    shapes = np.array([x[p - before : p + after] for p in at])
    scores = np.array([correlation(s, shapes.mean(0)) for s in shapes])
    return np.clip(np.interp(np.arange(len(x)), at, scores), 0, 1)


def pulse_quality(x: np.ndarray, fs: float, seconds: float = 30.0, fill: float = -0.15) -> np.ndarray:
    """Quality per sample of onset-to-onset pulses against the template of their stretch of `seconds`.

    A template is the mean, over the stretch's pulses, of as many samples as the median pulse has; pulses that correlate
    with it below 0.8 are left out of a second mean. A pulse's score is the mean of its correlation sample by sample and
    after stretching it to the template's length.
    """
    x = np.asarray(x, float)
    peaks, onsets = detector.peaks_and_onsets(x, fs)
    if len(onsets) < 3:
        return np.full(len(x), fill)
    scores = np.zeros(len(onsets) - 1)
    stretch = (onsets[:-1] // max(1, int(seconds * fs))).astype(int)
    for k in np.unique(stretch).tolist():
        own = np.flatnonzero(stretch == k)
        parts = [x[onsets[i] : onsets[i + 1]] for i in own]
        size = max(4, int(np.median([len(p) for p in parts])))
        direct = np.array([fit(p, size) for p in parts])
        mean = direct.mean(0)
        good = np.array([correlation(p, mean) > 0.8 for p in direct])
        template = direct[good].mean(0) if good.any() else mean
        grid = np.linspace(0, 1, size)
        for i, p, d in zip(own, parts, direct):
            stretched = np.interp(grid, np.linspace(0, 1, len(p)), p)
            scores[i] = (correlation(d, template) + correlation(stretched, template)) / 2
    return pulses_to_samples(onsets, scores, len(x), fill)


def fit(p: np.ndarray, n: int) -> np.ndarray:
    """Cut to n samples or held at the last one."""
    return p[:n] if len(p) >= n else np.pad(p, (0, n - len(p)), "edge")


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    scale = np.sqrt((a**2).sum() * (b**2).sum())
    return max(0.0, float((a * b).sum() / scale)) if scale > 1e-12 else 0.0


def pulses_to_samples(onsets: np.ndarray, scores: np.ndarray, n: int, fill: float = -0.15) -> np.ndarray:
    """Each pulse's score on its inclusive samples, the mean where two meet, fill elsewhere. Needs one onset more than scores."""
    if len(scores) != len(onsets) - 1:
        raise ValueError("one score per pulse is needed")
    total, count = np.zeros(n), np.zeros(n)
    for a, b, s in zip(onsets[:-1].tolist(), onsets[1:].tolist(), scores.tolist()):
        total[a : b + 1] += s
        count[a : b + 1] += 1
    return np.where(count > 0, total / np.maximum(count, 1), fill)


def whole_score(x: np.ndarray, fs: float) -> float:
    """The window score of a whole file."""
    return window_score(np.asarray(x, float), fs, P.systolic_peaks(x, fs))


def ensemble(x: np.ndarray, fs: float) -> np.ndarray:
    """Mean of the three estimators."""
    return (custom_quality(x, fs) + template_quality(x, fs) + pulse_quality(x, fs)) / 3


def all_estimates(x: np.ndarray, fs: float) -> dict[str, np.ndarray | None]:
    """Each estimator's quality within [0, 1]; None for one that fails, whose length differs or whose values are not finite."""
    out: dict[str, np.ndarray | None] = {}
    for name, estimate in (("custom", custom_quality), ("template", template_quality), ("pulse", pulse_quality)):
        try:
            q = np.asarray(estimate(x, fs), float)
            out[name] = np.clip(q, 0, 1) if q.shape == np.shape(x) and np.isfinite(q).all() else None
        except (ValueError, IndexError, FloatingPointError):
            out[name] = None
    return out


def ecg_quality(x: np.ndarray, fs: float) -> np.ndarray:
    """Distance of each beat from the mean QRS, scaled so that the closest beat gets 1; 0 without beats."""
    x = np.asarray(x, float)
    at, half = P.r_peaks(x, fs), max(2, int(0.2 * fs))
    at = at[(at >= half) & (at < len(x) - half)]
    if len(at) < 2:
        return np.zeros(len(x))
    shapes = np.array([x[p - half : p + half] for p in at])
    gap = np.sqrt(((shapes - shapes.mean(0)) ** 2).sum(1))
    score = 1 - (gap - gap.min()) / (gap.max() - gap.min() + 1e-12)
    return np.clip(np.interp(np.arange(len(x)), at, score), 0, 1)


def lag_error(a: np.ndarray, b: np.ndarray) -> float:
    """Mean squared difference of two signals over their overlap at the lag where their cross-correlation, without means, is
    largest in size; NaN for an empty one."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if not len(a) or not len(b):
        return float("nan")
    at = int(np.argmax(np.abs(np.correlate(a - a.mean(), b - b.mean(), mode="full")))) - (len(b) - 1)
    left, right = (a[at:], b) if at >= 0 else (a[: len(a) + at], b[-at:])
    n = min(len(left), len(right))
    return float(((left[:n] - right[:n]) ** 2).mean()) if n else float("nan")


def sweep_quality(magnitude: np.ndarray) -> float:
    """Quality of an impedance sweep: closeness of the scaled magnitude to its smoothed self, from 0 to 1."""
    m = np.asarray(magnitude, float)
    span = m.max() - m.min()
    scaled = (m - m.min()) / span if span > 0 else np.zeros(len(m))
    error = float(((scaled - filters.savgol(scaled)) ** 2).mean())
    best, worst = 2e-6, 0.002  # fixed values of the rating's range
    return float(np.clip((2 * worst - error - best) / (2 * (worst - best)), 0, 1))
