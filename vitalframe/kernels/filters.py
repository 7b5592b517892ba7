"""Array filters in NumPy: Butterworth designs, zero-phase filtering, Savitzky-Golay smoothing, outlier repair.

Everything takes and returns one-dimensional arrays of equal length. Filters are kept as second-order sections, which
stay accurate for narrow bands where one long polynomial does not.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=64)
def butter_sections(order: int, edges: tuple[float, ...], fs: float, kind: str) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital Butterworth filter: 'low', 'high' or 'band'.

    The analog prototype's poles lie evenly on a half circle; they are moved to the wanted edges, mapped by the
    bilinear transform, and paired with their conjugates.
    """
    warped = [2 * fs * np.tan(np.pi * e / fs) for e in edges]
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "low":
        poles, zeros, at = poles * warped[0], -np.ones(order), 0.0
    elif kind == "high":
        poles, zeros, at = warped[0] / poles, np.ones(order), np.pi
    else:
        width, middle = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - middle**2)
        poles, zeros = np.concatenate([half + root, half - root]), np.concatenate([np.ones(order), -np.ones(order)])
        at = 2 * np.arctan(middle / (2 * fs))
    digital = (2 * fs + poles) / (2 * fs - poles)
    real = np.sort(digital[np.abs(digital.imag) < 1e-12].real)
    upper = digital[digital.imag >= 1e-12]
    pairs = [(p, np.conj(p)) for p in upper[np.argsort(np.abs(upper))]] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    left, sections = sorted(zeros.tolist()), []
    for p in pairs:
        z = [left.pop(0)] + ([left.pop()] if len(p) == 2 and left else [])
        b, a = np.real(np.poly(z)), np.real(np.poly(p))
        sections.append(np.concatenate([b, np.zeros(3 - len(b)), a, np.zeros(3 - len(a))]))
    sos = np.array(sections)
    unit = np.exp(-1j * at * np.arange(3))
    for s in sos:  # unit gain in the pass band, section by section
        s[:3] /= abs(s[:3] @ unit) / abs(s[3:] @ unit)
    sos.flags.writeable = False
    return sos


def filter_sections(sos: np.ndarray, x: np.ndarray, settled: bool = True) -> np.ndarray:
    """Run the sections over x (transposed direct form II), starting as if x had always had its first value."""
    y = np.asarray(x, float)
    for b0, b1, b2, _, a1, a2 in sos.tolist():
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        s1 = s2 = 0.0
        if settled and len(y):
            first = float(y[0])
            s1, s2 = (gain - b0) * first, (b2 - a2 * gain) * first
        out = []
        for v in y.tolist():
            w = b0 * v + s1
            s1, s2 = b1 * v - a1 * w + s2, b2 * v - a2 * w
            out.append(w)
        y = np.array(out)
    return y


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over x, extended at both ends by its odd reflection."""
    x = np.asarray(x, float)
    pad = min(3 * (2 * len(sos) + 1), len(x) - 1)
    if pad < 1:
        return x.copy()
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    there = filter_sections(sos, wide)
    back = filter_sections(sos, there[::-1])[::-1]
    return back[pad : pad + len(x)]


def bandpass(x: np.ndarray, fs: float, low: float = 0.5, high: float = 4.0, order: int = 4) -> np.ndarray:
    return zero_phase(butter_sections(order, (low, min(high, 0.49 * fs)), fs, "band"), x)


def lowpass(x: np.ndarray, fs: float, cut: float = 20.0, order: int = 6) -> np.ndarray:
    return zero_phase(butter_sections(order, (min(cut, 0.49 * fs),), fs, "low"), x)


def highpass(x: np.ndarray, fs: float, cut: float = 0.5, order: int = 5) -> np.ndarray:
    return zero_phase(butter_sections(order, (cut,), fs, "high"), x)


@lru_cache(maxsize=64)
def _polynomial_fit(half: int, order: int) -> np.ndarray:
    """The matrix that takes a window to the coefficients of its polynomial."""
    fit = np.linalg.pinv(np.vander(np.arange(-half, half + 1), order + 1, increasing=True))
    fit.flags.writeable = False
    return fit


def savgol(x: np.ndarray, window: int = 11, order: int = 3) -> np.ndarray:
    """Local polynomial smoothing; at the edges the polynomial of the outermost window. Windows below 5 leave x as it is."""
    x = np.asarray(x, float)
    window = min(window, len(x))
    window -= 1 - window % 2
    if window < 5 or order >= window:
        return x.copy()
    half = window // 2
    fit = _polynomial_fit(half, order)
    out = np.convolve(x, fit[0][::-1], mode="same")
    for rows, part in ((slice(0, half), x[:window]), (slice(len(x) - half, len(x)), x[-window:])):
        place = np.arange(-half, 0) if rows.start == 0 else np.arange(1, half + 1)
        out[rows] = np.vander(place, order + 1, increasing=True) @ (fit @ part)
    return out


def zero_padded_median(x: np.ndarray, window: int) -> np.ndarray:
    """Moving median of an odd window over x, with zeros beyond its ends, kept sorted by insertion and removal."""
    from bisect import bisect_left, insort

    half, n = window // 2, len(x)
    padded = np.concatenate([np.zeros(half), x, np.zeros(half)]).tolist()
    held = sorted(padded[:window])
    out = np.empty(n)
    for i in range(n):
        out[i] = held[half]
        if i + 1 < n:
            del held[bisect_left(held, padded[i])]
            insort(held, padded[i + window])
    return out


def remove_outliers(x: np.ndarray, fs: float, window_ms: float | None = 2000.0, k: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Hampel repair: residuals from a moving median beyond k robust deviations are interpolated. Returns values and mask."""
    x = np.asarray(x, float)
    mean = x.mean() if len(x) else 0.0
    window = max(3, len(x) if window_ms is None else round(window_ms * fs / 1000)) | 1
    centred = x - mean
    residual = np.abs(centred - zero_padded_median(centred, window))
    sigma = 1.4826 * zero_padded_median(residual, window) + 1e-12
    mask = residual > k * sigma
    good = np.flatnonzero(~mask)
    fixed = centred.copy()
    if len(good) and mask.any():
        fixed[mask] = np.interp(np.flatnonzero(mask), good, centred[good])
    return fixed + mean, mask


def moving_average(x: np.ndarray, window: int) -> np.ndarray:
    """Mean over `window` samples with zeros beyond the ends."""
    return np.convolve(x, np.ones(window) / window, mode="same") if 1 < window <= len(x) else np.asarray(x, float)


def resample_fourier(x: np.ndarray, fs: float, target: float) -> np.ndarray:
    """int(n / fs * target) samples by cutting or extending the spectrum."""
    n, m = len(x), int(len(x) / fs * target)
    spectrum, keep = np.fft.rfft(x), min(n, m)
    wide = np.zeros(m // 2 + 1, complex)
    most = keep // 2 + 1
    wide[:most] = spectrum[:most]
    if keep % 2 == 0:
        wide[keep // 2] *= 0.5 if m > n else 1.0
        if m < n:
            wide[keep // 2] = 2 * wide[keep // 2].real if m % 2 == 0 else wide[keep // 2]
    return np.fft.irfft(wide, m) * m / n


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline through (x, y), evaluated at `at`, clamped to the ends. Fewer than four points: linear."""
    n = len(x)
    at = np.clip(at, x[0], x[-1])
    if n < 4:
        return np.interp(at, x, y)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    low, mid, up, right = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    mid[1:-1], low[1:-1], up[1:-1], right[1:-1] = 2 * (h[:-1] + h[1:]), h[:-1], h[1:], 6 * np.diff(slope)
    # Not-a-knot: the outer second derivatives continue the inner ones linearly; they are eliminated from the system.
    a, b = h[0] / h[1], h[-1] / h[-2]
    mid[1] += low[1] * (1 + a)
    up[1] -= low[1] * a
    mid[-2] += up[-2] * (1 + b)
    low[-2] -= up[-2] * b
    # Elimination goes number by number, for which lists are faster than arrays; the diagonal stays positive.
    m, below, c, d, diag = [0.0] * n, low.tolist(), up[1:-1].tolist(), right[1:-1].tolist(), mid[1:-1].tolist()
    for i in range(1, n - 2):
        f = below[i + 1] / diag[i - 1]
        diag[i] -= f * c[i - 1]
        d[i] -= f * d[i - 1]
    m[n - 2] = d[-1] / diag[-1]
    for i in range(n - 4, -1, -1):
        m[i + 1] = (d[i] - c[i] * m[i + 2]) / diag[i]
    m = np.array(m)
    m[0], m[-1] = (1 + a) * m[1] - a * m[2], (1 + b) * m[-2] - b * m[-3]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t, r = at - x[k], x[k + 1] - at
    return (m[k] * r**3 + m[k + 1] * t**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * r + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t


def resample_cubic(x: np.ndarray, fs: float, target: float) -> np.ndarray:
    at = np.arange(int(len(x) / fs * target)) / target
    return cubic_spline(np.arange(len(x)) / fs, np.asarray(x, float), at)
