"""Isolated pulses of a waveform: cleaning, cutting, selection by shape, and the morphology of one pulse."""

from __future__ import annotations

import numpy as np

from vitalframe.kernels import filters, peaks as P, spectrum

NAN = float("nan")
#: Smoothing window and order, band and order of the filter.
SMOOTH, BAND, ORDER = (19, 4), (0.5, 15.0), 4
#: Samples of an averaged pulse.
GRID = 200
#: Names of one pulse's features.
MORPHOLOGY = (
    "peak_value", "peak_pos", "rising_time", "skewness", "kurtosis_f", "kurtosis_p", "variance", "w75", "w50", "w25", "w10", "notch_y", "diastolic_peak_y", "diastolic_slope", "area", "area_1", "area_2", "IPA",
    "A", "B", "C", "D", "E", "B/A", "B/A_t", "C/A", "C/A_t", "D/A", "D/A_t", "E/A", "E/A_t", "X", "Y", "AI", "RI", "DT", "DTt")
POWER = ("MAX_POWER_1st", "IDX_MAX_1st", "F_MAX_1st", "MAX_POWER_2nd", "IDX_MAX_2nd", "F_MAX_2nd", "MEAN_PSD", "STD_PSD", "VAR_PSD", "KUR_PSD")


def normalised(x: np.ndarray) -> np.ndarray:
    """Scaled to [0, 1]; a flat signal becomes 1e10 throughout, which no later rule accepts."""
    span = np.ptp(x)
    return (x - x.min()) / span if span else np.full(len(x), 1e10)


def prepared(x: np.ndarray, fs: float) -> np.ndarray:
    """Smoothed, band-passed forwards only from a settled start, and scaled."""
    smooth = filters.savgol(np.asarray(x, float), *SMOOTH)
    sections = filters.butter_sections(ORDER, (BAND[0], min(BAND[1], 0.49 * fs)), fs, "band")
    return normalised(filters.filter_sections(sections, smooth))


def high_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    return P.find_peaks(x, height=0.5, distance=max(1, int(fs / 2)))


def lowest_between(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """The first lowest sample from each peak to the next."""
    return np.array([a + int(np.argmin(x[a:b])) for a, b in zip(peaks[:-1].tolist(), peaks[1:].tolist())], int)


def without_baseline(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """The signal less the line through the valleys between its peaks, and that line; with fewer than two peaks unchanged."""
    valleys = lowest_between(x, high_peaks(x, fs))
    if not len(valleys):
        return x, np.zeros(len(x))
    line = np.interp(np.arange(len(x)), valleys, x[valleys])
    return x - line, line


def cropped(x: np.ndarray, fs: float) -> np.ndarray:
    """From the valley after the first peak to the one before the last, held at both ends, and scaled. Needs three peaks."""
    valleys = lowest_between(x, high_peaks(x, fs))
    if len(valleys) < 2:
        raise ValueError("too few peaks to crop")
    first, last = int(valleys[0]), int(valleys[-1])
    peaks = high_peaks(x, fs)
    return normalised(np.pad(x[first:last], (first, last - int(peaks[-2])), "edge"))


def without_doubles(peaks: np.ndarray, gap: int = 5) -> np.ndarray:
    """Peaks but for those within `gap` samples after another one."""
    return peaks[np.concatenate([[True], np.diff(peaks) > gap])] if len(peaks) else peaks


def pulses_of(x: np.ndarray) -> list[np.ndarray]:
    """Pieces of the signal from valley to valley; the first one starts at the signal's start."""
    peaks = without_doubles(P.find_peaks(x, height=0.6, distance=50))
    cuts = np.concatenate([[0], lowest_between(x, peaks)]).astype(int) if len(peaks) else np.zeros(0, int)
    return [x[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The quality of a pulse by its correlation with the next one, over their common length."""
    n = min(len(a), len(b))
    a, b = a[:n] - a[:n].mean(), b[:n] - b[:n].mean()
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.exp(8 * 50 * ((a @ b / size if size else 0.0) + 1) / 99 - 8))


def fitted(pulse: np.ndarray, n: int) -> np.ndarray:
    """Cut to n samples or held at the last one."""
    return pulse[:n] if len(pulse) >= n else np.pad(pulse, (0, n - len(pulse)), "edge")


def _nearest(x: np.ndarray, level: float) -> int:
    return int(np.argmin(np.abs(x - level)))


def morphology(pulse: np.ndarray, fs: float) -> dict[str, float]:
    """Peak, widths, notch, diastolic peak, areas and the waves a to e of the second derivative of one pulse.

    Ratios of waves are ratios of their places, as the names' users expect. Widths are -1 where the peak is at the start.
    """
    x = np.asarray(pulse, float)
    if len(x) < 31:
        raise ValueError("the pulse is too short")
    top, value = int(np.argmax(x)), float(x.max())
    steps = np.append(np.diff(x), x[-1] - x[-2])
    bend = filters.savgol(np.append(np.diff(steps), steps[-1] - steps[-2]), 29, 4)
    c, var = x - x.mean(), x.var()
    kurt = (c**4).mean() / var**2 if var else NAN
    low, span = x.min(), np.ptp(x)
    width = lambda share: (top + _nearest(x[top:], low + share * span) - _nearest(x[:top], low + share * span)) / fs if top else -1.0
    least = int(np.argmin(bend))
    later = P.find_peaks(bend[least:], height=0.0)
    notch = least + int(later[0]) if len(later) else 0
    dia = notch + int(np.argmin(bend[notch:]))
    before, after = (float(np.trapezoid(part, dx=5)) if len(part) > 1 else 0.0 for part in (x[:notch], x[notch:]))
    waves = P.find_peaks(bend, height=0.0, distance=15).tolist()
    between = lambda i: waves[i] + int(np.argmin(bend[waves[i] : waves[i + 1]]))
    a, b, c_ = (waves[0], between(0), waves[1]) if len(waves) > 1 else (0, 0, 0)
    d, e = (between(1), waves[2]) if len(waves) > 2 else (0, 0)
    ratios = [v for w in (b, c_, d, c_) for v in (w / (a or 1e-12), w / (a or 1e-12) / fs * 1000)]  # the last wave's ratio uses c
    over, dia_over = value - x[-1], x[dia] - x[-1]
    values = (
        value, top, top - int(np.argmax(bend[:top])) if top else 0, (c**3).mean() / var**1.5 if var else NAN, kurt - 3, kurt, var, width(0.75), width(0.5), width(0.25), width(0.1), x[notch] if notch else 0.0, x[dia], (dia - top) / fs,
        round(float(np.trapezoid(x, dx=5)), 2), before, after, after / before if before else NAN, a or 1e-12, b, c_, d, e, *ratios, over, dia_over, (over - dia_over) / over if over else NAN, dia_over / over if over else NAN, abs(top - dia), abs(top - dia) / fs * 1000)
    return dict(zip(MORPHOLOGY, map(float, values)))


def well_shaped(x: np.ndarray, fs: float, rate: float) -> tuple[list[dict[str, float]], bool, list[np.ndarray]]:
    """Features of the pulses that resemble the next one and have a plausible length and form, whether there are enough
    pulses at all, and those pulses. The signal is resampled to `rate` first; the last pulse has no next one."""
    pulses = pulses_of(filters.resample_cubic(x, fs, rate))
    kept, shapes = [], []
    for p, following in zip(pulses[:-1], pulses[1:]):
        if min(len(p), len(following)) < 5 or similarity(p, following) <= 0.8 or not int(0.4 * rate) < len(p) < int(1.2 * rate):
            continue
        try:
            found = morphology(fitted(p, int(rate)), rate)
        except ValueError:
            continue
        if found["peak_pos"] <= 150 and 0 < found["skewness"] < 2 and found["IPA"] < 1.5:
            kept.append(found)
            shapes.append(fitted(p, int(rate)))
    return kept, len(pulses) >= 5, shapes


def isolated_features(pulses: list[np.ndarray], rate: float) -> list[dict[str, float]]:
    """The morphology of each pulse but the last, cut or held to a second."""
    return [morphology(fitted(p, int(rate)), rate) for p in pulses[:-1]]


def power_features(x: np.ndarray, fs: float) -> dict[str, float]:
    """The strongest line of the spectrum, the next peak above it, and the spectrum's moments."""
    f, p = spectrum.welch(x, fs, min(256, len(x)))
    first = int(np.argmax(p))
    later = P.local_maxima(p)
    later = later[later >= first]
    second = int(later[1]) if len(later) > 1 else None
    c = p - p.mean()
    values = (p[first], first, f[first], *((p[second], second, f[second]) if second is not None else (0, 0, 0)), p.mean(), p.std(), p.var(ddof=1), (c**4).mean() / p.var() ** 2 - 3 if p.var() else NAN)
    return dict(zip(POWER, map(float, values)))


def inverted_and_level(x: np.ndarray, fs: float) -> np.ndarray:
    """Prepared, turned around in time, without baseline."""
    return without_baseline(prepared(x, fs)[::-1], fs)[0]


Shaped = tuple[list[dict[str, float]], bool, list[np.ndarray]]


def average_pulse(level: np.ndarray, fs: float, rate: float, shaped: Shaped | None = None) -> np.ndarray:
    """The median of at least three scaled pulses on a grid of GRID samples, their peaks moved to the median peak's place.
    `shaped` is what well_shaped gives, if it is known."""
    pulses = (shaped or well_shaped(level, fs, rate))[2]
    if len(pulses) < 3:
        pulses = pulses_of(filters.resample_cubic(level, fs, rate))
    pulses = [p for p in pulses if 0.4 * rate <= len(p) <= 1.8 * rate and p.std() >= 1e-4]
    if len(pulses) < 3:
        raise ValueError("too few pulses")
    shapes = [fitted(filters.resample_cubic((p - p.min()) / (np.ptp(p) or 1.0), fs, rate), GRID) for p in pulses]
    places = [int(np.argmax(s)) for s in shapes]
    middle = int(np.median(places))
    moved = [np.concatenate([np.full(max(0, middle - k), s[0]), s[max(0, k - middle) : GRID - max(0, middle - k)], np.full(max(0, k - middle), s[-1])]) for s, k in zip(shapes, places)]
    return np.median(moved, axis=0)


def segment_pulse(level: np.ndarray, fs: float, rate: float, shaped: Shaped | None = None) -> np.ndarray:
    """The mean of the well-shaped pulses on GRID samples; needs five pulses in the segment and one that is well shaped."""
    _, enough, pulses = shaped or well_shaped(level, fs, rate)
    if not enough or not pulses:
        raise ValueError("too few pulses")
    return np.mean([fitted(p, GRID) for p in pulses], axis=0)
