"""Mutual information of continuous samples by nearest neighbours (Kraskov, Stoegbauer and Grassberger, 2004)."""

from __future__ import annotations

import numpy as np


#: Harmonic numbers are summed up to here; above, the series is exact to double precision.
SUMMED = 1024
#: Points of a leaf, and distances that are held at once.
LEAF, HELD = 24, 1 << 21


def digamma(n: np.ndarray) -> np.ndarray:
    """Digamma at positive integers: harmonic numbers less Euler's constant, or its series for large ones."""
    n = np.asarray(n)
    harmonic = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, SUMMED))])
    large = np.maximum(n, SUMMED).astype(float)
    series = np.log(large) - 1 / (2 * large) - 1 / (12 * large**2) + 1 / (120 * large**4)
    return np.where(n > SUMMED, series, harmonic[np.minimum(n, SUMMED).astype(int) - 1] - np.euler_gamma)


def ends_within(s: np.ndarray, v: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and one past the last member of the sorted s that are closer to each v than its reach, by true distances."""
    low, high = np.searchsorted(s, v - reach, side="left"), np.searchsorted(s, v + reach, side="right")
    last = len(s) - 1
    while (far := (high > 0) & (s[np.maximum(high - 1, 0)] - v >= reach)).any():
        high -= far
    while (near := (high <= last) & (s[np.minimum(high, last)] - v < reach)).any():
        high += near
    while (far := (low <= last) & (v - s[np.minimum(low, last)] >= reach)).any():
        low += far
    while (near := (low > 0) & (v - s[np.maximum(low - 1, 0)] < reach)).any():
        low -= near
    return low, high


def _within(s: np.ndarray, v: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """How many members of the sorted s are closer to each v than its reach, by their true distances."""
    low, high = ends_within(s, v, reach)
    return high - low


class Plane:
    """Points in a balanced tree, each node halved along its wider side, for nearest distances (the larger of both
    coordinates'). A node is left out if its box is no nearer than the k-th distance known."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.n = n = len(x)
        self.levels = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        size = -(-n // (1 << self.levels)) << self.levels
        x, y = (np.concatenate([v, np.repeat(v[-1:], size - n)]) for v in (x, y))  # copies fill up and never count
        at = np.arange(size)[None]
        for _ in range(self.levels):
            u, v = x[at], y[at]
            side = np.where((np.ptp(u, axis=1) >= np.ptp(v, axis=1))[:, None], u, v)
            half = at.shape[1] // 2
            at = np.take_along_axis(at, np.argpartition(side, half, axis=1), axis=1).reshape(-1, half)
        self.at, self.x, self.y, self.fill = at, x[at], y[at], at >= n
        box = np.stack([self.x.min(1), self.x.max(1), self.y.min(1), self.y.max(1)])
        self.boxes = [box]
        for _ in range(self.levels):
            two = self.boxes[0].reshape(4, -1, 2)
            self.boxes.insert(0, np.stack([two[0].min(1), two[1].max(1), two[2].min(1), two[3].max(1)]))

    def _leaves(self, x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of the leaves that are nearer than each query's bound."""
        q, node = np.arange(len(x)), np.zeros(len(x), int)
        for level, box in enumerate(self.boxes):
            if level:
                q, node = np.repeat(q, 2), np.stack([2 * node, 2 * node + 1], 1).ravel()
            b, u, v = box[:, node], x[q], y[q]
            near = np.maximum(np.maximum(b[0] - u, u - b[1]), np.maximum(b[2] - v, v - b[3])) < bound[q]
            q, node = q[near], node[near]
        return q, node

    def nearer(self, x: np.ndarray, y: np.ndarray, best: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """best, the k smallest distances known of each query, with those of the points but for the leaf `own`."""
        k, out = best.shape[1], best.copy()
        for part in np.array_split(np.arange(len(x)), max(1, len(x) >> 14)):
            bound = best[part, k - 1]
            q, leaf = self._leaves(x[part], y[part], bound)
            if own is not None:
                q, leaf = (c[leaf != own[part[q]]] for c in (q, leaf))
            ids, gaps = [], []
            for at in np.array_split(np.arange(len(q)), max(1, len(q) * self.at.shape[1] // HELD)):
                p, j = part[q[at]], leaf[at]
                gap = np.maximum(np.abs(self.x[j] - x[p, None]), np.abs(self.y[j] - y[p, None]))
                row, col = np.nonzero((gap < bound[q[at], None]) & ~self.fill[j])
                ids.append(q[at][row])
                gaps.append(gap[row, col])
            q, gap = np.concatenate(ids), np.concatenate(gaps)
            some = np.unique(q)
            q = np.concatenate([np.repeat(some, k), q])
            gap = np.concatenate([best[part[some]].ravel(), gap])
            order = np.lexsort((gap, q))
            first = np.searchsorted(q[order], some)
            out[part[some]] = gap[order][first[:, None] + np.arange(k)]
        return out

    def nearest(self, k: int) -> np.ndarray:
        """The k smallest distances of each point from the other ones, rising; infinite where there are fewer."""
        leaves, size = self.at.shape
        best = np.full((leaves, size, k), np.inf)
        for part in np.array_split(np.arange(leaves), max(1, leaves * size * size // HELD)):
            x, y = self.x[part], self.y[part]
            gap = np.maximum(np.abs(x[:, :, None] - x[:, None]), np.abs(y[:, :, None] - y[:, None]))
            gap[np.broadcast_to(self.fill[part][:, None], gap.shape)] = np.inf
            gap[:, np.arange(size), np.arange(size)] = np.inf
            kept = min(k, size)
            best[part, :, :kept] = np.sort(np.partition(gap, kept - 1, axis=2)[:, :, :kept], axis=2)
        real = ~self.fill.ravel()
        own = np.repeat(np.arange(leaves), size)[real]
        found = self.nearer(self.x.ravel()[real], self.y.ravel()[real], best.reshape(-1, k)[real], own)
        out = np.empty((self.n, k))
        out[self.at.ravel()[real]] = found
        return out


def neighbour_reach(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The distance, the larger of both coordinates', of each point to its k-th nearest other one."""
    return Plane(x, y).nearest(k)[:, k - 1]


def neighbour_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """I(X; Y) in nats, at least 0; NaN below five rows, 0 for a constant side."""
    good = np.isfinite(x) & np.isfinite(y)
    x, y = x[good], y[good]
    n = len(x)
    if n < 5:
        return float("nan")
    if np.ptp(x) == 0 or np.ptp(y) == 0:
        return 0.0
    x, y = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    # ties are parted by the place squared, the same way each time; a line of places would make new ones
    square = np.arange(n, dtype=float) ** 2
    x, y = (v + 1e-10 * (square * step % 1.0) for v, step in ((x, 0.6180339887498949), (y, 0.7548776662466927)))
    reach = neighbour_reach(x, y, k)
    total = sum(digamma(np.maximum(_within(np.sort(v), v, reach), 1)).sum() for v in (x, y))
    return max(0.0, float(digamma(np.array([k]))[0] + digamma(np.array([n]))[0] - total / n))
