"""Beats of a pulse wave by band-pass filters that follow the heart rate (Aboy et al., 2005), and repairs of their points."""

from __future__ import annotations

import numpy as np

from vitalframe.kernels import filters, peaks as P

#: Plausible rates in beats a minute, the percentile that slopes must reach, and the shares of the median
#: interval below and above which an interval is too short or too long; seconds of a window and samples a second inside.
SLOWEST, FASTEST, STEEP, SHORT, LONG, WINDOW, RATE = 30, 200, 75, 0.5, 2.25, 10, 75


def heart_rate(x: np.ndarray, fs: float, before: float = 0.0) -> int:
    """Whole beats a minute of the strongest line of a Blackman-windowed spectrum, near the rate before if there is one."""
    f = np.fft.rfftfreq(len(x), 1 / fs)
    p = np.abs(np.fft.rfft((x - x.mean()) * np.blackman(len(x)))) ** 2
    low, high = (SLOWEST / 60, FASTEST / 60) if not SLOWEST <= before <= FASTEST else (before / 120, before / 60 * 1.4)
    inside = np.flatnonzero((f >= low) & (f <= high))
    return int(60 * f[inside[np.argmax(p[inside])]]) if len(inside) else 0


def slope(x: np.ndarray) -> np.ndarray:
    """The first derivative of the local parabola through five samples."""
    return np.convolve(x, np.array([2.0, 1.0, 0.0, -1.0, -2.0]) / 10, mode="same")


def passed(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    return filters.bandpass(x, fs, low, min(high, 0.45 * fs), 3)


def maxima(x: np.ndarray, percentile: float, apart: float = 0.0) -> np.ndarray:
    """Local maxima above a percentile of the signal, at least `apart` samples from a higher one."""
    return P.find_peaks(x, height=float(np.percentile(x, percentile)) if percentile else None, distance=max(1, int(apart)))


def following(slopes: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """The first top after each steepest rise."""
    at = np.searchsorted(tops, slopes, side="right")
    return np.unique(tops[at[at < len(tops)]])


def short_intervals(seconds: np.ndarray, rate: float) -> np.ndarray:
    return seconds < SHORT * 60 / rate


def long_intervals(seconds: np.ndarray, rate: float) -> np.ndarray:
    return seconds > LONG * 60 / rate


def corrected(beats: np.ndarray, tops: np.ndarray, rate: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Beats moved to the nearest maximum of the signal itself, without those that follow another too soon; and whether
    the interval after each is too long, so that a beat may be missing."""
    if not len(beats) or not len(tops):
        return beats, np.zeros(0, bool)
    near = np.clip(np.searchsorted(tops, beats), 1, max(1, len(tops) - 1))
    moved = np.unique(np.where(np.abs(tops[np.minimum(near, len(tops) - 1)] - beats) < np.abs(tops[near - 1] - beats), tops[np.minimum(near, len(tops) - 1)], tops[near - 1]))
    keep = np.concatenate([[True], ~short_intervals(np.diff(moved) / fs, rate)])
    return moved[keep], long_intervals(np.diff(moved[keep]) / fs, rate)


def onsets_of(x: np.ndarray, fs: float, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each peak the last lowest point before it since the peak before; pairs closer than a thirtieth of a second drop out."""
    starts = np.concatenate([[max(0, int(peaks[0] - fs))], peaks[:-1]]).astype(int) if len(peaks) else np.zeros(0, int)
    onsets = []
    for a, b in zip(starts.tolist(), peaks.tolist()):
        low = P.local_maxima(-x[a : b + 1])
        onsets.append(a + (int(low[np.argmin(x[a + low])]) if len(low) else int(np.argmin(x[a : b + 1]))))
    onsets = np.array(onsets, int)
    fine = peaks - onsets >= fs / 30 if len(peaks) else np.zeros(0, bool)
    return onsets[fine], peaks[fine]


def peaks_and_onsets(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Systolic peaks and the onset of each. In windows that overlap by a fifth the heart rate is estimated from a wide
    band; peaks of a moderate band that follow a steep rise of a narrow one are beats."""
    x = np.asarray(x, float)
    slow = filters.resample_cubic(x, fs, RATE)
    width = min(len(slow), WINDOW * RATE)
    if width < 2 * RATE:
        return np.zeros(0, int), np.zeros(0, int)
    starts = [*range(0, len(slow) - width, round(0.8 * width)), len(slow) - width]
    found, rates, before = [], [], 0.0
    for a in starts:
        part, low = slow[a : a + width], 0.9 * SLOWEST / 60
        rate = heart_rate(passed(part, RATE, low, 3 * FASTEST / 60), RATE, before)
        if rate < 1:
            continue
        before = rate
        rates.append(rate)
        apart = RATE / 3 if rate > 40 else 0
        rises = maxima(slope(passed(part, RATE, low, max(2.5 * rate / 60, 2 * low))), STEEP, apart)
        tops = maxima(passed(part, RATE, low, max(10 * rate / 60, 2 * low)), 50, apart)
        found.append(a + following(rises, tops))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    beats, _ = corrected(np.unique(np.concatenate(found)), P.local_maxima(slow), float(np.median(rates)), RATE)
    peaks = np.clip(np.unique((beats / RATE * fs).astype(int)), 0, len(x) - 1)
    onsets, peaks = onsets_of(x, fs, peaks)
    # A peak is the highest point between two onsets; onsets follow the moved peaks.
    for i, (a, b) in enumerate(zip(onsets[:-1].tolist(), onsets[1:].tolist())):
        if b > a:
            peaks[i] = a + int(np.argmax(x[a:b]))
    onsets, peaks = onsets_of(x, fs, np.unique(peaks))
    keep = np.concatenate([[True], np.diff(onsets) > 0]) if len(onsets) else np.zeros(0, bool)
    return peaks[keep], onsets[keep]


def jerk_points(third: np.ndarray, on: int, off: int, b: int | None, c: int | None, d: int | None) -> tuple[int | None, int | None]:
    """p1, the first maximum of the third derivative after b; p2, its last minimum from p1 to d, or without a d behind c the
    first one after c."""
    start = on if b is None else b
    up = P.local_maxima(third[start:off])
    if off - start < 3:
        return None, None
    p1 = start + (int(up[0]) if len(up) else int(np.argmax(third[start:off])))
    behind = d is not None and c is not None and d > c
    a, e, pick = (p1, d, -1) if behind else (c if c is not None else p1, off, 0)
    low = P.local_maxima(-third[a:e]) if e - a >= 3 else np.zeros(0, int)
    return p1, a + int(low[pick]) if len(low) else e


def repaired(points: dict[str, int | None], x: np.ndarray, first: np.ndarray, third: np.ndarray, fs: float) -> dict[str, int | None]:
    """The points of a pulse after rules on their order: the onset at the lowest sample near it or, failing that, at the
    largest third derivative before a; the notch at a dip between the peaks; v before e; w from e to f."""
    p = dict(points)
    on, sp, off = p["on"], p["sp"], p["off"]
    wing = max(1, int(0.005 * fs))
    if on + int(np.argmin(x[max(0, on - wing) : on + wing])) - min(on, wing) != on and p["a"] is not None:
        back = min(p["a"], max(1, int(0.075 * fs)))
        p["on"] = p["a"] - back + int(np.argmax(third[p["a"] - back : p["a"]])) if back else on
    if p["dp"] is not None and p["dp"] > sp:
        dips = sp + P.local_maxima(-x[sp : p["dp"]])
        if len(dips) and p["dp"] - dips[-1] > round(fs / 100):
            p["dn"] = int(dips[-1])
    if p["e"] is not None and p["f"] is not None and p["e"] < p["f"]:
        if p["v"] is not None and p["u"] is not None and p["v"] > p["e"] > p["u"]:
            p["v"] = p["u"] + int(np.argmin(first[p["u"] : p["e"]]))
        if p["w"] is not None and p["w"] > p["f"]:
            p["w"] = p["f"]
        elif p["w"] is not None and p["w"] < p["e"]:
            p["w"] = p["e"] + int(np.argmax(first[p["e"] : p["f"]]))
    return p if p["on"] < sp < off else dict(points)
