"""Grouped evaluation of models that are fitted on every row of a large table.

No training set is gathered. Each outer fold has its own inner folds, and a row is in one cell (outer fold held out, inner
fold) for each outer fold but its own, so a training set is a sum of cells:

* dummy and lasso follow from the cells' Gram matrices (operators.gram), the median from counts and the rows of few bins;
* knn is exact. Rows are dealt to tiles; a tile also gets the rows around it that its own could reach. A row's nearest
  rows count if they are nearer than what was looked at, else it looks again as far as it must;
* gpr is the posterior mean given all rows, with its covariance as a polynomial of both rows. The polynomials' Gram matrix
  comes from their moments, which add up over rows. The squared exponential is met to rounding; a Matern covariance, which
  has a kink, is met on average as a polynomial of this degree can, and closer for smooth or noisy settings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import product
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.functions.nulls import clean_num
from vitalframe.kernels.regressors import covariance
from vitalframe.operators import gram as G
from vitalframe.operators import splits
from vitalframe.session import cut_lineage

FAMILIES = ("dummy", "lasso", "knn", "gpr")
#: Bins that the median is looked for in, and bins of all axes together that tiles are made of.
BINS, CELLS = 4096, 1 << 18
#: Rows of a tile and of a leaf, leaves whose reach is one box, the nearest rows that a row looks at first, and rows that look at once.
TILE, LEAF, JOINED, NEAR, LOOKED = 1 << 16, 64, 64, 96, 512
#: Polynomials of a covariance at most, their degree at most, and rows whose polynomials are held at once.
POLYNOMIALS, DEGREE, HELD = 1771, 60, 2048


@dataclass
class Cells:
    """The complete rows in cells. held: the outer folds; counts[i]: inner folds of the i-th; grams[i][f]: the matrix of a cell."""

    rows: DataFrame  # _key, fold, _y (NaN where missing), _x0.., _f0.. (the inner fold, -1 in the row's own outer fold)
    held: list[int]
    size: int
    counts: list[int]
    centre: np.ndarray
    grams: list[dict[int, np.ndarray]]

    def sets(self) -> DataFrame:
        """(_i, _f, _y, _x): each row in all of its cells."""
        known = self.rows.where(~F.isnan("_y")).select("_y", F.array(*[f"_x{j}" for j in range(self.size)]).alias("_x"), F.posexplode(F.array(*[f"_f{i}" for i in range(len(self.held))])).alias("_i", "_f"))
        return known.where("_f >= 0")

    def training(self, i: int, f: int | None) -> np.ndarray:
        """The matrix of outer fold i's training rows, without those of inner fold f if one is given."""
        total = sum(self.grams[i].values())
        return total if f is None else total - self.grams[i][f]

    def each(self) -> list[tuple[int, int | None]]:
        """All training sets: (outer fold's place, inner fold held out or None)."""
        return [(i, f) for i, g in enumerate(self.grams) if g for f in ([*sorted(g)] if self.counts[i] > 1 else []) + [None]]

    def best(self, i: int, errors: dict[tuple[int, int], np.ndarray], settings: int) -> int:
        """The setting with the least mean RMSE over inner folds, of equals the first; errors are sums of squares."""
        if self.counts[i] < 2:
            return 0
        each = [np.sqrt(errors[i, f] / g[0, 0]) for f, g in self.grams[i].items()]
        return int(np.argmin(np.mean(each, axis=0)))


def in_cells(data: DataFrame, features: list[str], inner: int) -> Cells:
    """The cells of a table (_key, fold, _y, features)."""
    size = len(features)
    rows = data.select("_key", "fold", F.coalesce(clean_num("_y"), F.lit(float("nan"))).alias("_y"), *[clean_num(f).alias(f"_x{j}") for j, f in enumerate(features)]).dropna(subset=[f"_x{j}" for j in range(size)])
    named = cut_lineage(rows.where(~F.isnan("_y")).select("_key", "fold"))
    groups = {r["fold"]: r["n"] for r in named.groupBy("fold").agg(F.count_distinct("_key").alias("n")).collect()}  # one row per fold
    held = sorted(groups)
    counts = [min(inner, sum(n for g, n in groups.items() if g != h)) for h in held]
    parts = [splits.group_folds(named.where(F.col("fold") != h), "_key", k).select("_key", F.lit(i).alias("_i"), F.col("fold").alias("_f")) for i, (h, k) in enumerate(zip(held, counts)) if k]
    names = [f"_f{i}" for i in range(len(held))]
    if parts:
        dealt = parts[0]
        for p in parts[1:]:
            dealt = dealt.unionByName(p)
        dealt = dealt.groupBy("_key").agg(*[F.max(F.when(F.col("_i") == i, F.col("_f"))).alias(n) for i, n in enumerate(names)])
        rows = rows.join(dealt, "_key", "left").withColumns({n: F.coalesce(n, F.lit(-1)) for n in names})
    else:
        rows = rows.withColumns({n: F.lit(-1) for n in names})
    cells = Cells(cut_lineage(rows), held, size, counts, np.zeros(size + 1), [{} for _ in held])
    sets = cells.sets()
    cells.centre = G.centre_of(cells.rows.where(~F.isnan("_y")).select("_y", F.array(*[f"_x{j}" for j in range(size)]).alias("_x")), size)
    for r in G.grams(sets, ["_i", "_f"], cells.centre).collect():  # outer * inner rows
        cells.grams[r["_i"]][r["_f"]] = G.square(r["gram"], size + 2)
    return cells


def _binned(edges: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """The number of a row's bin, over all axes."""
    shape = [len(e) + 1 for e in edges]

    def run(x: np.ndarray) -> np.ndarray:
        return np.ravel_multi_index([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], shape)

    return run


def _cuts(rows: DataFrame, names: list[str], bins: int) -> list[np.ndarray]:
    return [np.unique(q) for q in rows.approxQuantile(names, np.linspace(0, 1, bins + 1)[1:-1].tolist(), 0.5 / bins)]


def medians(cells: Cells) -> dict[tuple[int, int | None], float]:
    """The exact median of the target in every training set: bins are counted, then the values in the bins that hold one."""
    edges = _cuts(cells.rows.where(~F.isnan("_y")), ["_y"], BINS)

    @F.pandas_udf("long")
    def place(y: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges[0], y.to_numpy(), side="left"))

    sets = cells.sets().select("_i", "_f", "_y").withColumn("_b", place("_y"))
    count = np.zeros((len(cells.held), max(cells.counts, default=0), len(edges[0]) + 1), np.int64)
    for r in sets.groupBy("_i", "_f", "_b").count().collect():  # outer * inner * bins rows
        count[r["_i"], r["_f"], r["_b"]] = r["count"]

    def wanted(c: np.ndarray) -> list[tuple[int, int]]:
        """(bin, place in it) of the middle rows."""
        up = np.cumsum(c)
        return [(b := int(np.searchsorted(up, at, side="right")), at - int(up[b] - c[b])) for at in ((int(up[-1]) - 1) // 2, int(up[-1]) // 2)]

    asked = {(i, f): wanted(count[i].sum(0) - (0 if f is None else count[i, f])) for i, f in cells.each()}
    bins = sorted({b for pair in asked.values() for b, _ in pair})
    values = sets.where(F.col("_b").isin(bins)).groupBy("_i", "_f", "_b", "_y").count().toPandas().sort_values("_y", kind="stable")
    found = {}
    for (i, f), pair in asked.items():
        own = values[(values["_i"] == i) & ((values["_f"] != f) if f is not None else True)]
        ends = []
        for b, at in pair:
            part = own[own["_b"] == b]
            ends.append(float(part["_y"].iloc[int(np.searchsorted(np.cumsum(part["count"].to_numpy()), at, side="right"))]))
        found[i, f] = float(np.mean(ends))
    return found


def dummies(cells: Cells, grid: list[dict]) -> dict[int, Callable]:
    middle = medians(cells) if any(s.get("how", "mean") != "mean" for s in grid) else {}
    shift = cells.centre[-1]
    level = lambda s, i, f: G.moments(cells.training(i, f))[1][-1] + shift if s.get("how", "mean") == "mean" else middle[i, f]
    line = lambda v: np.array([v - shift, *[0.0] * cells.size])
    errors = {(i, f): np.array([G.squared_error(cells.grams[i][f], line(level(s, i, f))) for s in grid]) for i, f in cells.each() if f is not None}
    return {i: constant(level(grid[cells.best(i, errors, len(grid))], i, None)) for i, f in cells.each() if f is None}


def constant(v: float) -> Callable:
    return lambda z: np.full(len(z), v)


def lassos(cells: Cells, grid: list[dict]) -> dict[int, Callable]:
    fits = [G.elastic_net(**s) for s in grid]
    errors = {(i, f): np.array([G.squared_error(cells.grams[i][f], fit(cells.training(i, f))) for fit in fits]) for i, f in cells.each() if f is not None}
    return {i: _line(fits[cells.best(i, errors, len(grid))](cells.training(i, None)), cells.centre) for i, f in cells.each() if f is None}


def _line(w: np.ndarray, centre: np.ndarray) -> Callable:
    return lambda z: (z - centre[:-1]) @ w[1:] + w[0] + centre[-1]


# Neighbours


def leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in leaves of at most so many, halved along the longest side; leaves that follow each other lie near."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        at = stack.pop()
        if len(at) <= size:
            out.append(at)
            continue
        part = x[at]
        half, axis = len(at) // 2, int(np.argmax(part.max(0) - part.min(0)))
        order = np.argpartition(part[:, axis], half)
        stack += [at[order[half:]], at[order[:half]]]
    return out


def reached(x: np.ndarray, radius: np.ndarray, least: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of scaled rows, in a fixed order of values, their corners, and how far each looks: as asked, or else three
    quarters of its longest side."""
    if not len(x):
        return [], np.zeros((0, x.shape[1])), np.zeros((0, x.shape[1])), np.zeros(0)
    order = np.lexsort((radius, *x.T[::-1]))
    made = [order[at] for at in leaves(x[order], LEAF)]
    low, high = np.array([x[at].min(0) for at in made]), np.array([x[at].max(0) for at in made])
    asked = np.array([radius[at].max() for at in made])
    return made, low, high, np.where(asked > 0, asked, np.maximum(0.75 * (high - low).max(1), least))


@dataclass
class Nearest:
    """What a task needs to look for neighbours: the grid, and of each training set the scale, rows and reach."""

    grid: list[dict]
    held: list[int]
    size: int
    base: np.ndarray  # the scale that all distances are bounded in
    scale: np.ndarray  # [outer, inner or last: none]: deviation of each feature
    ratio: np.ndarray  # [outer, inner]: least distance in that scale of what is 1 apart in the base
    rows: np.ndarray  # [outer, inner]: training rows
    least: float
    whole: float  # a radius that takes in everything

    @property
    def names(self) -> list[str]:
        return [f"_x{j}" for j in range(self.size)]

    @property
    def inner(self) -> list[str]:
        return [f"_f{i}" for i in range(len(self.held))]

    def look(self, x, fold, part, base, cand, bound):
        """Of queries and their candidates (places in base, -1 for none): the values of each (query, outer fold, setting), which
        of them are certain, and how far the others must look."""
        bx, by, codes = base
        n, most, every = len(x), max(s["k"] for s in self.grid), np.arange(len(x))
        values = np.full((n, len(self.held), len(self.grid)), np.nan)
        sure, far = np.ones((n, len(self.held)), bool), np.zeros(n)
        gaps, full = [np.abs(x[:, j, None] - bx[j][cand]) for j in range(self.size)], bool((cand >= 0).all())
        for i, h in enumerate(self.held):
            own = fold == h
            f = np.where(own, self.scale.shape[1] - 1, part[:, i])
            asked = (own | (part[:, i] >= 0)) & (self.rows[i, f] > 0)
            code = codes[i][cand]
            barred = (code == -2) | (code == np.where(own, -3, part[:, i]).astype(np.int8)[:, None])
            if not full:
                barred |= cand < 0
            want = np.minimum(most, self.rows[i, f]).astype(int)
            scaled = [g / self.scale[i, f, j, None] for j, g in enumerate(gaps)]
            for p in sorted({s.get("p", 2) for s in self.grid}):
                left = sum(scaled) if p == 1 else np.sqrt(sum(g * g for g in scaled))
                np.putmask(left, barred, np.inf)
                total, weight, last = np.zeros(n), np.zeros(n), np.full(n, np.inf)
                near, dist, made = [], [], {}
                for k in range(most):
                    at = left.argmin(1) if cand.shape[1] else every[:0]
                    d = left[every, at] if cand.shape[1] else np.full(n, np.inf)
                    y = by[cand[every, at]] if cand.shape[1] else np.zeros(n)
                    use = k < want
                    last = np.where(use, d, last)
                    if cand.shape[1]:
                        left[every, at] = np.inf
                    total, weight = total + np.where(use, y, 0.0), weight + use
                    near.append(np.where(use, y, 0.0))
                    dist.append(np.where(use, d, np.inf))
                    made[k + 1] = total / np.maximum(weight, 1)
                good = ~asked | (last < self.ratio[i, f] * bound)
                sure[:, i] &= good
                far = np.maximum(far, np.where(good, 0.0, last / self.ratio[i, f]))
                for j, s in enumerate(self.grid):
                    if s.get("p", 2) != p:
                        continue
                    v = made[s["k"]]
                    if s.get("weights", "uniform") != "uniform":  # rows at distance zero alone where there are any
                        d, y = np.array(dist[: s["k"]]), np.array(near[: s["k"]])
                        w = np.where((d == 0).any(0), d == 0, 1.0 / np.maximum(d, 1e-300))
                        v = (w * y).sum(0) / np.where(w.sum(0) > 0, w.sum(0), 1.0)
                    values[asked, i, j] = v[asked]
        return values, sure, far

    def boxes(self, b: pd.DataFrame) -> pd.DataFrame:
        """What a tile's rows could reach, in boxes."""
        _, low, high, far = reached(b[self.names].to_numpy(float) / self.base, b["_r"].to_numpy(float), self.least)
        low, high = low - far[:, None], high + far[:, None]
        at = range(0, len(low), JOINED)
        return pd.DataFrame({"_tile": int(b["_tile"].iloc[0]), "low": [low[k : k + JOINED].min(0) for k in at], "high": [high[k : k + JOINED].max(0) for k in at]})

    def tile(self, b: pd.DataFrame) -> pd.DataFrame:
        """The rows of a tile whose neighbours are certain with their values, the others with the distance to look at, and
        the sums of squared errors of each cell."""
        b = b.sort_values(["fold", "_key", "_y", *self.names], kind="stable", ignore_index=True)
        role, inner = b["_role"].to_numpy(), b[self.inner].to_numpy(int)
        data, y = b[self.names].to_numpy(float), b["_y"].to_numpy(float)
        x, fold = data / self.base, b["fold"].to_numpy(int)
        # Of equal rows of one cell, only the first can be among the nearest.
        known = (role != 1) & np.isfinite(y)
        most = max(s["k"] for s in self.grid)
        keep = np.flatnonzero(known)[(b.loc[known].groupby([*self.names, "fold", *self.inner], sort=False).cumcount() < most).to_numpy()]
        codes = [np.where(fold[keep] == h, -2, inner[keep, i]).astype(np.int8) for i, h in enumerate(self.held)]
        bx, base = x[keep], ([np.ascontiguousarray(data[keep, j]) for j in range(self.size)], y[keep], codes)
        blocks = leaves(bx, LEAF) if len(keep) else []
        low = np.array([bx[at].min(0) for at in blocks]).reshape(-1, self.size)
        high = np.array([bx[at].max(0) for at in blocks]).reshape(-1, self.size)
        asks = np.flatnonzero(role > 0)
        made, qlow, qhigh, far = reached(x[asks], b["_r"].to_numpy(float)[asks], self.least)
        sums = np.zeros((len(self.held), self.scale.shape[1], len(self.grid)))
        place = {h: i for i, h in enumerate(self.held)}
        own = np.array([place.get(v, -1) for v in fold])
        done, todo, waiting = [], [], []

        def settle(at, values):
            for i in range(len(self.held)):
                ours = (own[at] != i) & (inner[at, i] >= 0) & np.isfinite(y[at])
                np.add.at(sums[i], inner[at, i][ours], (values[ours, i] - y[at][ours, None]) ** 2)
            done.append((at, values[np.arange(len(at)), own[at]]))

        def later(at, away, radius):
            todo.append((at, np.where(np.isfinite(away), away * (1 + 1e-9) + self.least, 4 * min(radius, self.whole))))

        def judge():
            at = np.concatenate([w[0] for w in waiting])
            cand, bound = np.concatenate([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting])
            values, sure, away = self.look(data[at], fold[at], inner[at], base, cand, bound)
            good = sure.all(1)
            settle(at[good], values[good])
            start = 0
            for rows, _, near, cand, radius in waiting:
                mine = slice(start, start + len(rows))
                start += len(rows)
                seen = ~good[mine] & (near >= radius)  # all within reach was looked at
                later(rows[seen], away[mine][seen], radius)
                bad = rows[~good[mine] & ~seen]  # those that must see all that lies within reach
                step = max(1, (1 << 17) // max(1, len(cand)))
                for k in range(0, len(bad), step):
                    q = bad[k : k + step]
                    values, sure, off = self.look(data[q], fold[q], inner[q], base, np.broadcast_to(cand, (len(q), len(cand))), np.full(len(q), radius))
                    fine = sure.all(1)
                    settle(q[fine], values[fine])
                    later(q[~fine], off[~fine], radius)
            waiting.clear()

        for rows, lo, hi, radius in zip(made, qlow, qhigh, far):
            lo, hi = lo - radius, hi + radius
            hit = np.flatnonzero(((low <= hi) & (high >= lo)).all(1))
            cand = np.sort(np.concatenate([blocks[k] for k in hit])) if len(hit) else np.zeros(0, np.intp)
            cand = cand[((bx[cand] >= lo) & (bx[cand] <= hi)).all(1)]
            radius = np.inf if radius >= self.whole else radius
            for k in range(0, len(rows), step := max(1, (1 << 20) // max(1, len(cand)))):
                at = asks[rows[k : k + step]]
                if len(cand) > NEAR:
                    d = sum((x[at, j, None] - bx[None, cand, j]) ** 2 for j in range(self.size))
                    near = np.argpartition(d, NEAR - 1, axis=1)[:, :NEAR]
                    bound = np.minimum(radius, np.sqrt(np.take_along_axis(d, near, axis=1).max(1)))
                    near = np.sort(cand[near], axis=1)
                else:
                    near, bound = np.full((len(at), NEAR), -1), np.full(len(at), radius)
                    near[:, : len(cand)] = cand
                if len(keep):
                    waiting.append((at, near, bound, cand, radius))
                else:
                    todo.append((at, np.full(len(at), 4 * min(radius, self.whole))))
            if sum(len(w[0]) for w in waiting) >= LOOKED:
                judge()
        if waiting:
            judge()
        out = []
        if done:
            at, v = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
            out.append(pd.DataFrame({"kind": 0, "_key": b["_key"].to_numpy()[at], "fold": fold[at], "_y": y[at], "_r": 0.0, "x": None, "part": None, "v": list(v)}))
        if todo and len(at := np.concatenate([t[0] for t in todo])):
            out.append(pd.DataFrame({"kind": 1, "_key": b["_key"].to_numpy()[at], "fold": fold[at], "_y": y[at], "_r": np.concatenate([t[1] for t in todo]), "x": list(data[at]), "part": list(inner[at]), "v": None}))
        for i, f in product(range(len(self.held)), range(self.scale.shape[1] - 1)):
            if sums[i, f].any():
                out.append(pd.DataFrame({"kind": 2, "_key": [None], "fold": i, "_y": 0.0, "_r": 0.0, "x": None, "part": [[f]], "v": [sums[i, f]]}))
        return pd.concat([o.astype({"_key": object}) for o in out], ignore_index=True) if out else pd.DataFrame(columns=["kind", "_key", "fold", "_y", "_r", "x", "part", "v"])


def _tiles(rows: DataFrame, names: list[str], base: np.ndarray, tiles: int) -> Callable[[np.ndarray], np.ndarray]:
    """Where a row belongs: bins of all axes, counted over all rows, are halved along their longest side."""
    edges = _cuts(rows, names, max(2, min(BINS, int(CELLS ** (1 / len(names))))))
    place, shape = _binned(edges), [len(e) + 1 for e in edges]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(int(np.prod(shape)), np.int64)
        for b in batches:
            total += np.bincount(place(b[names].to_numpy(float)), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    weight = np.zeros(int(np.prod(shape)), np.int64)
    for r in rows.select(*names).mapInPandas(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most CELLS rows
        weight[r["at"]] = r["n"]
    weight, number = weight.reshape(shape), np.zeros(shape, np.int32)
    ends = [np.concatenate([e[:1], e, e[-1:]]) / s for e, s in zip(edges, base)]
    stack, made = [([(0, n) for n in shape], tiles)], 0
    while stack:
        box, share = stack.pop()
        part = weight[tuple(slice(*s) for s in box)]
        longest = sorted((j for j, (a, z) in enumerate(box) if z - a > 1), key=lambda j: ends[j][box[j][0]] - ends[j][box[j][1]])
        if share < 2 or part.sum() <= 4 * LEAF or not longest:
            number[tuple(slice(*s) for s in box)] = made
            made += 1
            continue
        j = longest[0]
        up = np.cumsum(part.sum(tuple(k for k in range(len(box)) if k != j)))
        cut = box[j][0] + min(max(1, int(np.searchsorted(up, up[-1] / 2)) + 1), box[j][1] - box[j][0] - 1)
        stack += [([*box[:j], (cut, box[j][1]), *box[j + 1 :]], share // 2), ([*box[:j], (box[j][0], cut), *box[j + 1 :]], share - share // 2)]
    flat = number.ravel()
    return lambda x: flat[place(x)]


def neighbours(cells: Cells, grid: list[dict]) -> tuple[DataFrame, dict[int, int]]:
    """(kind 0, _key, fold, _y, v: a value per setting) of all rows by their outer training sets, and each outer fold's setting."""
    rows, outer, most = cells.rows, len(cells.held), max(cells.counts, default=0)
    scale, count = np.ones((outer, most + 1, cells.size)), np.zeros((outer, most + 1))
    for i, f in cells.each():
        n, _, s, _, _ = G.standardised(cells.training(i, f))
        scale[i, most if f is None else f], count[i, most if f is None else f] = s, n
    base = scale[:, most].mean(0)
    names = [f"_x{j}" for j in range(cells.size)]
    r = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}{a}") for c in names for a, f in (("a", F.min), ("z", F.max))]).first()
    width = np.array([r[f"{c}z"] - r[f"{c}a"] for c in names]) / base
    whole = float(np.sqrt((width**2).sum())) + 1.0
    task = Nearest(grid, cells.held, cells.size, base, scale, (base / scale).min(2) * (1 - 1e-9), count, 1e-6 * whole, whole)
    par = rows.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, min(max(r["n"] // TILE, 4 * par), r["n"] // (16 * LEAF)))
    of = _tiles(rows, names, base, int(tiles))
    kind = rows.schema["_key"].dataType.simpleString()
    columns = ["_key", "fold", "_y", *names, *task.inner]
    schema = f"_key {kind}, fold int, _y double, " + "".join(f"{c} double, " for c in names) + "".join(f"{c} int, " for c in task.inner) + "_r double, _tile int, _role int"

    def dealt(boxes: pd.DataFrame | None, role: int):
        """The rows in their own tiles (role 1 asks only, role 2 asks and answers), and as answers (role 0) in all tiles that reach them."""
        by_tile = {} if boxes is None else {t: (np.vstack(g["low"].to_list()), np.vstack(g["high"].to_list())) for t, g in boxes.groupby("_tile")}
        ids = np.array(list(by_tile), np.int32)
        low, high = np.array([v[0].min(0) for v in by_tile.values()]), np.array([v[1].max(0) for v in by_tile.values()])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if b.empty:
                    continue
                data = b[names].to_numpy(float)
                x, tile = data / base, of(data)
                if role:
                    yield b.assign(_tile=tile, _role=role)
                known = np.isfinite(b["_y"].to_numpy(float))
                if boxes is None or not len(ids):
                    continue
                inside = np.broadcast_to(known[:, None], (len(b), len(ids))).copy()
                if role == 2:
                    inside &= tile[:, None] != ids
                for j in range(len(names)):
                    inside &= (x[:, j, None] >= low[:, j]) & (x[:, j, None] <= high[:, j])
                for k in np.flatnonzero(inside.any(0)):
                    at = np.flatnonzero(inside[:, k])
                    lo, hi = by_tile[int(ids[k])]
                    hit = np.zeros(len(at), bool)
                    for m in range(len(lo)):
                        hit |= ((x[at] >= lo[m]) & (x[at] <= hi[m])).all(1)
                    if hit.any():
                        yield b.iloc[at[hit]].assign(_tile=ids[k], _role=0)

        return run

    def round_of(asking: DataFrame, first: bool) -> DataFrame:
        near = asking.select(*names, "_r").mapInPandas(lambda batches: (b.assign(_tile=of(b[names].to_numpy(float))) for b in batches if len(b)), "".join(f"{c} double, " for c in names) + "_r double, _tile int")
        boxes = near.groupBy("_tile").applyInPandas(lambda b: task.boxes(b), "_tile int, low array<double>, high array<double>").toPandas()  # one row for some thousand rows
        all_rows = rows.select(*columns).withColumn("_r", F.lit(0.0))
        if first:
            met = all_rows.mapInPandas(dealt(boxes, 2), schema)
        else:
            met = asking.mapInPandas(dealt(None, 1), schema).unionByName(all_rows.mapInPandas(dealt(boxes, 0), schema))
        return cut_lineage(met.repartition(int(tiles), "_tile").groupBy("_tile").applyInPandas(lambda b: task.tile(b), f"kind int, _key {kind}, fold int, _y double, _r double, x array<double>, part array<int>, v array<double>"))

    asking, found = rows.select(*columns).withColumn("_r", F.lit(0.0)), []
    while True:
        made = round_of(asking, not found)
        found.append(made)
        asking = made.where("kind = 1").select("_key", "fold", "_y", *[F.col("x")[j].alias(c) for j, c in enumerate(names)], *[F.col("part")[i].alias(c) for i, c in enumerate(task.inner)], "_r")
        if asking.isEmpty():
            break
    done = found[0]
    for d in found[1:]:
        done = done.unionByName(d)
    errors: dict[tuple[int, int], np.ndarray] = {(i, f): np.zeros(len(grid)) for i, f in cells.each() if f is not None}
    sums = done.where("kind = 2").select(F.col("fold").alias("_i"), F.col("part")[0].alias("_f"), F.posexplode("v").alias("_j", "_v")).groupBy("_i", "_f", "_j").agg(F.sum("_v").alias("_v"))
    for s in sums.collect():  # outer * inner * settings rows
        if (s["_i"], s["_f"]) in errors:
            errors[s["_i"], s["_f"]][s["_j"]] = s["_v"]
    return done.where("kind = 0"), {i: cells.best(i, errors, len(grid)) for i, f in cells.each() if f is None}


# Gaussian processes


class Polynomials:
    """Products of Chebyshev polynomials up to a total degree on a box, and what follows from their moments."""

    def __init__(self, low: np.ndarray, high: np.ndarray, degree: int):
        self.mid, self.half, self.degree, d = (low + high) / 2, np.where(high > low, (high - low) / 2, 1.0), degree, len(low)
        self.exponents = np.array([e for e in product(range(degree + 1), repeat=d) if sum(e) <= degree])
        self.norm = np.sqrt(2.0) ** (self.exponents > 0).sum(1)
        self.first = np.array(sorted((e for e in product(range(2 * degree + 1), repeat=d - 1) if sum(e) <= 2 * degree), key=sum)).reshape(-1, d - 1)
        self.short = int((self.first.sum(1) <= degree).sum())

    def axes(self, z: np.ndarray, top: int) -> list[np.ndarray]:
        """The polynomials of each axis, up to a degree."""
        u, out = (z - self.mid) / self.half, []
        for j in range(z.shape[1]):
            t = np.empty((len(z), top + 1))
            t[:, 0] = 1.0
            if top:
                t[:, 1] = u[:, j]
            for n in range(2, top + 1):
                t[:, n] = 2 * u[:, j] * t[:, n - 1] - t[:, n - 2]
            out.append(t)
        return out

    def values(self, z: np.ndarray) -> np.ndarray:
        t, out = self.axes(z, self.degree), np.tile(self.norm, (len(z), 1))
        for j, a in enumerate(t):
            out *= a[:, self.exponents[:, j]]
        return out

    def length(self) -> int:
        return len(self.first) * (2 * self.degree + 1) + self.short * (self.degree + 1) + 2

    def moments(self, z: np.ndarray, y: np.ndarray, groups: list[np.ndarray]) -> list[np.ndarray]:
        """The moments of each group of rows: of the polynomials up to twice the degree, of them with the target, and of the target."""
        t = self.axes(z, 2 * self.degree)
        a = np.ones((len(z), len(self.first)))
        for j in range(self.first.shape[1]):
            a *= t[j][:, self.first[:, j]]
        out = []
        for at in groups:
            part, last = a[at], t[-1][at]
            out.append(np.concatenate([(part.T @ last).ravel(), (part[:, : self.short].T @ (last[:, : self.degree + 1] * y[at, None])).ravel(), [y[at].sum(), (y[at] ** 2).sum()]]))
        return out

    def opened(self, m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float, float]:
        """Of moments: rows, sums of the polynomials, of them with the target, their Gram matrix, and the target's sums."""
        d, top = self.exponents.shape[1], 2 * self.degree + 1
        full, own = np.zeros([top] * d), np.zeros([self.degree + 1] * d)
        cut = len(self.first) * top
        full[tuple(self.first.T)] = m[:cut].reshape(-1, top)
        own[tuple(self.first[: self.short].T)] = m[cut:-2].reshape(-1, self.degree + 1)
        at, flat = tuple(self.exponents.T), full.ravel()
        steps = [top ** (d - 1 - j) for j in range(d)]
        gram = np.zeros((len(self.exponents),) * 2)
        for signs in product((1, -1), repeat=d):
            place = np.zeros(gram.shape, np.int32)
            for j, s in enumerate(signs):
                e = self.exponents[:, j].astype(np.int32)
                place += np.abs(e[:, None] + s * e) * np.int32(steps[j])
            gram += flat[place]
        gram *= np.outer(self.norm, self.norm) / 2**d
        return float(full.ravel()[0]), self.norm * full[at], self.norm * own[at], gram, float(m[-2]), float(m[-1])


def process_line(poly: Polynomials, v: np.ndarray, level: float) -> Callable:
    """The polynomial with these coefficients."""
    d, p = poly.exponents.shape[1], poly.degree + 1
    full = np.zeros([p] * d)
    full[tuple(poly.exponents.T)] = v * poly.norm
    full = full.reshape(-1, p)

    def predict(z: np.ndarray) -> np.ndarray:
        out = np.empty(len(z))
        for k in range(0, len(z), HELD):
            t = poly.axes(z[k : k + HELD], poly.degree)
            a = np.ones((len(t[0]), 1))
            for b in t[:-1]:
                a = (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)
            out[k : k + HELD] = ((a @ full) * t[-1]).sum(1) + level
        return out

    return predict


def degree_for(size: int) -> int:
    return max(d for d in range(1, DEGREE + 1) if comb(d + size, size) <= POLYNOMIALS)


def points_of(poly: Polynomials, mean: np.ndarray, scale: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Points that polynomials are fitted at: two for each all over the box, closest at its sides, and one more where rows lie."""
    rng, (count, size) = np.random.default_rng(42), poly.exponents.shape
    box = poly.mid + poly.half * np.cos(np.pi * rng.uniform(size=(3 * count, size)))
    near = mean[:-1] + centre[:-1] + scale * rng.normal(size=(count, size))
    inside = (np.abs(near - poly.mid) <= poly.half).all(1)
    box[:count][inside] = near[inside]
    return box


def covariance_of(inverse: np.ndarray, points: np.ndarray, kernel: str, length: float) -> np.ndarray:
    """The covariance as coefficients of both rows' polynomials, by least squares over points of the box."""
    out = np.zeros((len(inverse),) * 2)
    for k in range(0, len(points), 512):
        out += (inverse @ covariance(points, points[k : k + 512], kernel, length)) @ inverse[:, k : k + 512].T
    return (out + out.T) / 2


def processes(cells: Cells, grid: list[dict], degree: int | None = None) -> dict[int, Callable]:
    """The tuned process of each outer fold, given all of its training rows."""
    size, spark = cells.size, cells.rows.sparkSession
    names, inner, shift = [f"_x{j}" for j in range(size)], [f"_f{i}" for i in range(len(cells.held))], float(cells.centre[-1])
    ends = cells.rows.agg(*[f(c).alias(f"{c}{a}") for c in names for a, f in (("a", F.min), ("z", F.max))]).first()
    poly = Polynomials(np.array([ends[f"{c}a"] for c in names]), np.array([ends[f"{c}z"] for c in names]), degree or degree_for(size))

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k in range(0, len(b), HELD):
                part = b.iloc[k : k + HELD]
                cell = part[inner].to_numpy(int)
                keys = [(i, f) for i in range(len(inner)) for f in np.unique(cell[:, i]) if f >= 0]
                found = poly.moments(part[names].to_numpy(float), part["_y"].to_numpy(float) - shift, [np.flatnonzero(cell[:, i] == f) for i, f in keys])
                for key, m in zip(keys, found):
                    held[key] = held[key] + m if key in held else m
        if held:
            yield pd.DataFrame({"_i": [i for i, _ in held], "_f": [f for _, f in held], "m": list(held.values())})

    one = lambda b: pd.DataFrame({"_i": b["_i"].iloc[:1], "_f": b["_f"].iloc[:1], "m": [np.sum(np.vstack(b["m"].to_list()), axis=0)]})
    schema = "_i int, _f int, m array<double>"
    sums = cells.rows.where(~F.isnan("_y")).mapInPandas(added, schema).groupBy("_i", "_f").applyInPandas(one, schema)
    moments: dict[int, dict[int, np.ndarray]] = {}
    for r in sums.toPandas().itertuples(index=False):  # outer * inner rows
        moments.setdefault(int(r[0]), {})[int(r[1])] = np.asarray(r[2])
    points = points_of(poly, *G.standardised(sum(g for i, f in cells.each() if f is None for g in cells.grams[i].values()))[1:3], cells.centre)
    v = poly.values(points)
    inverse = np.linalg.solve(v.T @ v, v.T)
    scales = {(i, f): G.standardised(cells.training(i, f))[2] for i, f in cells.each()}
    kinds = sorted({(s["kernel"], s["length"]) for s in grid})
    shared = spark.sparkContext.broadcast((moments, points, inverse))

    def solved(i: int, f: int | None, kernel: str, length: float, alphas: Iterable[float]):
        cell, points, inverse = shared.value
        own = sum(m for g, m in cell[i].items() if g != f)
        n, ones, both, gram, first, second = poly.opened(own)
        mean = first / n
        c = covariance_of(inverse, points / scales[i, f], kernel, length)
        gc, t = gram @ c, both - mean * ones
        return mean, {a: c @ np.linalg.solve(gc + a * np.eye(len(c)), t) for a in alphas}

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, f, k in zip(b["_i"], b["_f"], b["_k"]):
                mine = [j for j, s in enumerate(grid) if (s["kernel"], s["length"]) == kinds[k]]
                mean, found = solved(int(i), int(f), *kinds[k], [grid[j]["alpha"] for j in mine])
                n, ones, both, gram, first, second = poly.opened(shared.value[0][int(i)][int(f)])
                sums = [second - 2 * mean * first + n * mean**2 - 2 * w @ (both - mean * ones) + w @ gram @ w for w in (found[grid[j]["alpha"]] for j in mine)]
                yield pd.DataFrame({"_i": int(i), "_f": int(f), "_j": mine, "sum": np.maximum(sums, 0.0)})

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j in zip(b["_i"], b["_j"]):
                s = grid[int(j)]
                mean, found = solved(int(i), None, s["kernel"], s["length"], [s["alpha"]])
                yield pd.DataFrame({"_i": [int(i)], "level": mean, "w": [found[s["alpha"]]]})

    jobs = [(i, f, k) for i, f in cells.each() if f is not None for k in range(len(kinds))]
    table: dict[tuple[int, int], np.ndarray] = {(i, f): np.zeros(len(grid)) for i, f in cells.each() if f is not None}
    if jobs:
        for r in spark.createDataFrame(jobs, "_i int, _f int, _k int").repartition(len(jobs)).mapInPandas(errors, "_i int, _f int, _j int, sum double").collect():
            table[r["_i"], r["_f"]][r["_j"]] = r["sum"]
    chosen = [(i, cells.best(i, table, len(grid))) for i, f in cells.each() if f is None]
    if not chosen:
        return {}
    made = spark.createDataFrame(chosen, "_i int, _j int").repartition(len(chosen)).mapInPandas(last, "_i int, level double, w array<double>").collect()
    return {r["_i"]: process_line(poly, np.array(r["w"]), r["level"] + shift) for r in made}


def fitted(data: DataFrame, features: list[str], models: Iterable[str], inner: int, families: dict) -> tuple[dict[tuple[str, int], Callable], DataFrame | None]:
    """The tuned model of each (family, outer fold), and the neighbours' predictions as (_key, fold, _y, predicted)."""
    models = list(models)
    if odd := sorted(set(models) - set(FAMILIES)):
        raise ValueError(f"no fit on every row for {odd}: give fold_rows")
    if "gpr" in models and any("length" not in s for s in families["gpr"][1]):
        raise ValueError("gpr on every row needs settings with a fixed length: give fold_rows")
    if len(features) > 3 and {"knn", "gpr"} & set(models):
        raise ValueError("knn and gpr on every row take three features at most: give fold_rows")
    cells = in_cells(data, features, inner)
    found: dict[tuple[str, int], Callable] = {}
    for name, fit in (("dummy", dummies), ("lasso", lassos), ("gpr", processes)):
        if name in models:
            found |= {(name, cells.held[i]): m for i, m in fit(cells, families[name][1]).items()}
    near = None
    if "knn" in models:
        done, chosen = neighbours(cells, families["knn"][1])
        value = F.lit(None).cast("double")
        for i, j in chosen.items():
            value = F.when(F.col("fold") == cells.held[i], F.col("v")[j]).otherwise(value)
        near = done.select("_key", "fold", F.when(~F.isnan("_y"), F.col("_y")).alias("_y"), F.when(~F.isnan(value), value).alias("predicted"))
    return found, near
