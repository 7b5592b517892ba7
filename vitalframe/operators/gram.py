"""Linear models from additive Gram matrices: every row counts, and the rows are read once.

The Gram matrix of (1, features, target), less a centre, is a sum over rows. So one aggregation gives it for each part of
a table; a training set is the total less what is held out, scaling follows from its means and variances, and errors on
held-out rows are quadratic forms of their own matrix. Tuning, leave-one-out fits and backward elimination then work on
matrices of the features' size, never on rows.

Rows with a missing target or feature are left out; fill them before (operators.stats.clean_and_impute). A feature
without variance has coefficient 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.functions.nulls import clean_num

#: The penalties that the tuner tries.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
#: A pivot, or a variance, up to so much of its first size is rounding.
ROUNDING = 1e-10
#: Matrices that a task holds before it sends them on, in numbers.
HELD = 1 << 20
#: Rows of a matrix whose entries are still plain sums of expressions.
FEW = 10

Fit = Callable[[np.ndarray], np.ndarray]


def complete_rows(rows: DataFrame, keep: list[str], target: str, features: list[str]) -> DataFrame:
    """The columns to keep, the target as _y, and the features as an array _x; rows with a missing one are left out."""
    made = rows.select(*keep, clean_num(F.col(target).cast("double")).alias("_y"), F.array(*[clean_num(F.col(f).cast("double")) for f in features]).alias("_x"))
    return made.where(F.col("_y").isNotNull() & ~F.exists("_x", lambda v: v.isNull()))


def centre_of(data: DataFrame, size: int) -> np.ndarray:
    """The mean of the features and the target: one row. Taking it off keeps sums of squares small."""
    means = data.agg(*[F.avg(F.col("_x")[i]) for i in range(size)], F.avg("_y")).first()
    return np.array([m or 0.0 for m in means], float)


def grams(data: DataFrame, keys: list[str], centre: np.ndarray, maps: list[Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """(keys, gram): the upper triangle of Z'Z, row by row, Z = (1, _x, _y) less the centre, summed for each key.

    With maps, there is a matrix for each of them, of the features that it makes of _x, and its number comes first as
    _map; the centre is that of mapped features then. A task adds up the rows of a key that it meets; the sums of tasks
    meet entry by entry, so a key that holds a large part of the table is no larger group than any other. The entries of a
    small matrix are sums of expressions.
    """
    size, width = len(centre) + 1, len(centre) - 1
    if not maps and size <= FEW:
        z = [F.lit(1.0), *[F.col("_x")[i] - F.lit(float(c)) for i, c in enumerate(centre[:-1])], F.col("_y") - F.lit(float(centre[-1]))]
        summed = data.groupBy(*keys).agg(*[F.sum(z[i] * z[j]).alias(f"_g{n}") for n, (i, j) in enumerate(zip(*np.triu_indices(size)))])
        return summed.select(*keys, F.array(*[f"_g{n}" for n in range(size * (size + 1) // 2)]).alias("gram"))
    upper = np.triu_indices(size)
    own = [*(["_map"] if maps else []), *keys]
    kinds = "".join(f"`{k}` {data.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            made = pd.DataFrame(list(held), columns=own).assign(gram=[g[upper] for g in held.values()])
            held.clear()
            return made

        for b in batches:
            if b.empty:
                continue
            x, groups = np.vstack(b["_x"].to_list()), b.groupby(keys, sort=False, dropna=False).indices
            for number, made in enumerate([m(x) for m in maps] if maps else [x]):
                z = np.column_stack([np.ones(len(b)), made.reshape(len(b), width), b["_y"]])
                z[:, 1:] -= centre
                for key, at in groups.items():
                    key = (*([number] if maps else []), *(key if isinstance(key, tuple) else (key,)))
                    held[key] = held.get(key, 0.0) + z[at].T @ z[at]
            if len(held) * size * size > HELD:
                yield flush()
        if held:
            yield flush()

    parts = data.select(*keys, "_x", "_y").mapInPandas(run, f"{'_map int, ' if maps else ''}{kinds}gram array<double>")
    sums = parts.select(*own, F.posexplode("gram").alias("_at", "_v")).groupBy(*own, "_at").agg(F.sum("_v").alias("_v"))
    return sums.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda e: e["_v"]).alias("gram"))


def square(packed, size: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    g = np.zeros((size, size))
    g[np.triu_indices(size)] = packed
    return g + np.triu(g, 1).T


def moments(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means, and the sums of squares about the means, of features and target."""
    n = g[0, 0]
    mean = g[0, 1:] / n if n else np.zeros(len(g) - 1)
    return n, mean, g[1:, 1:] - n * np.outer(mean, mean)


def standardised(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means, the deviation of each feature (1 without variance), and X'X and X'y of the features so scaled."""
    n, mean, c = moments(g)
    variance = np.diag(c)[:-1] / max(n, 1.0)
    scale = np.where(variance > ROUNDING * (np.diag(g)[1:-1] / max(n, 1.0)), np.sqrt(np.maximum(variance, 0)), 0.0)
    flat = scale == 0
    scale = np.where(flat, 1.0, scale)
    a, b = c[:-1, :-1] / np.outer(scale, scale), c[:-1, -1] / scale
    a[flat], a[:, flat], b[flat] = 0.0, 0.0, 0.0
    return n, mean, scale, a, b


def _raw(mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Intercept and coefficients for features as they are, from those of scaled ones."""
    w = w / scale
    return np.concatenate([[mean[-1] - mean[:-1] @ w], w])


def ridge(alpha: float) -> Fit:
    """Least squares with a penalty on the coefficients of scaled features."""

    def fit(g: np.ndarray) -> np.ndarray:
        _, mean, scale, a, b = standardised(g)
        return _raw(mean, scale, np.linalg.lstsq(a + alpha * np.eye(len(a)), b, rcond=ROUNDING)[0])

    return fit


def elastic_net(alpha: float, l1_ratio: float = 1.0, rounds: int = 1000, tolerance: float = 1e-9) -> Fit:
    """Coordinate descent on the Gram matrix of scaled features; l1_ratio 1 is the lasso. The loss is half the mean square."""

    def fit(g: np.ndarray) -> np.ndarray:
        n, mean, scale, a, b = standardised(g)
        a, b, w = a / max(n, 1.0), b / max(n, 1.0), np.zeros(len(b))
        hard, soft = alpha * l1_ratio, alpha * (1 - l1_ratio)
        for _ in range(rounds):
            moved = 0.0
            for k in np.flatnonzero(np.diag(a) > 0):
                pull = b[k] - a[k] @ w + a[k, k] * w[k]
                new = np.sign(pull) * max(abs(pull) - hard, 0.0) / (a[k, k] + soft)
                moved, w[k] = max(moved, abs(new - w[k])), new
            if moved <= tolerance:
                break
        return _raw(mean, scale, w)

    return fit


def ridge_paths(g: np.ndarray, alphas: list[float]) -> np.ndarray:
    """What ridge(alpha) gives for each matrix of a stack, as (alphas, matrices, intercept and coefficients): one
    decomposition of a matrix serves all penalties."""
    n = np.maximum(g[:, 0, 0], 1.0)
    mean = np.where(g[:, :1, 0] > 0, g[:, 0, 1:] / n[:, None], 0.0)
    c = g[:, 1:, 1:] - g[:, :1, :1] * mean[:, :, None] * mean[:, None, :]
    variance = np.einsum("bii->bi", c)[:, :-1] / n[:, None]
    flat = ~(variance > ROUNDING * np.einsum("bii->bi", g)[:, 1:-1] / n[:, None])
    scale = np.where(flat, 1.0, np.sqrt(np.maximum(variance, 0)))
    a = np.where(flat[:, :, None] | flat[:, None, :], 0.0, c[:, :-1, :-1] / (scale[:, :, None] * scale[:, None, :]))
    b = np.where(flat, 0.0, c[:, :-1, -1] / scale)
    values, turn = np.linalg.eigh(a)
    turned, out = np.einsum("bij,bi->bj", turn, b), []
    for alpha in alphas:
        pull = values + alpha
        good = np.abs(pull) > ROUNDING * np.abs(pull).max(axis=1, keepdims=True)
        w = np.einsum("bij,bj->bi", turn, np.where(good, turned / np.where(good, pull, 1.0), 0.0)) / scale
        out.append(np.column_stack([mean[:, -1] - (mean[:, :-1] * w).sum(1), w]))
    return np.array(out)


def tuned_ridges(parts: np.ndarray, alphas: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """What tuned and the fit of its choice give for ridge, for a stack of (part, matrix): places of penalties, and weights."""
    total = parts.sum(axis=1)
    errors, held = np.zeros((len(alphas), len(parts))), np.zeros(len(parts))
    for g in np.moveaxis(parts, 1, 0):
        good = (0 < g[:, 0, 0]) & (g[:, 0, 0] < total[:, 0, 0])
        if good.any():
            v = np.concatenate([w := ridge_paths(total[good] - g[good], alphas), -np.ones((*w.shape[:2], 1))], axis=2)
            square = np.maximum(np.einsum("abi,bij,abj->ab", v, g[good], v), 0.0)
            errors[:, good] += np.sqrt(square / g[good][:, 0, 0])
            held += good
    best = np.argmin(np.round(errors / np.maximum(held, 1), 12), axis=0)
    return best, ridge_paths(total, alphas)[best, np.arange(len(parts))]


def mean_only(g: np.ndarray) -> np.ndarray:
    """The baseline: the mean of the target."""
    return np.concatenate([[moments(g)[1][-1]], np.zeros(len(g) - 2)])


def squared_error(g: np.ndarray, w: np.ndarray) -> float:
    """The sum of squared errors, on the rows of g, of intercept and coefficients w."""
    v = np.concatenate([w, [-1.0]])
    return max(float(v @ g @ v), 0.0)


def tuned(parts: dict[int, np.ndarray], fits: list[Fit]) -> int:
    """The place of the fit with the least mean RMSE over parts, each held out from the others; of equals the first."""
    total = sum(parts.values())
    held = [g for g in parts.values() if 0 < g[0, 0] < total[0, 0]]
    if not held:
        return 0
    errors = [np.mean([np.sqrt(squared_error(g, fit(total - g)) / g[0, 0]) for g in held]) for fit in fits]
    return int(np.argmin(np.round(errors, 12)))


def families(sets: dict[str, list[dict]]) -> dict[str, tuple[list[dict], list[Fit]]]:
    """Settings and fits of the linear families: ridge, lasso, elasticnet and dummy."""
    makers = {"ridge": ridge, "lasso": elastic_net, "elasticnet": elastic_net, "dummy": lambda: mean_only}
    return {m: (grid, [makers[m](**s) for s in grid]) for m, grid in sets.items()}


LINEAR = {"dummy": [{}], "ridge": [{"alpha": a} for a in ALPHAS]}


def nested_linear(rows: DataFrame, fold: str, inner: str, target: str, features: list[str], sets: dict[str, list[dict]] = LINEAR) -> DataFrame:
    """(model, fold, setting, n_train, n_test, rmse, r2, weights) of each family and outer fold, over all complete rows.

    Each family is tuned over the inner parts of the other folds' rows and refitted on all of them. One aggregation by
    (fold, inner) is all that reads the table; its few matrices, of the features' size, reach the driver.
    """
    data = complete_rows(rows, [fold, inner], target, features)
    size, centre = len(features) + 2, centre_of(data, len(features))
    cells = {(r[fold], r[inner]): square(r["gram"], size) for r in grams(data, [fold, inner], centre).collect()}
    made = []
    for h in sorted({f for f, _ in cells}):
        test = sum(g for (f, _), g in cells.items() if f == h)
        parts: dict = {}
        for (f, i), g in cells.items():
            if f != h:
                parts[i] = parts.get(i, 0.0) + g
        if not parts:
            continue
        train, spread = sum(parts.values()), moments(test)[2][-1, -1]
        for model, (grid, fits) in families(sets).items():
            k = tuned(parts, fits)
            w = fits[k](train)
            error = squared_error(test, w)
            made.append((model, h, ",".join(f"{n}={v:g}" for n, v in grid[k].items()), int(round(train[0, 0])), int(round(test[0, 0])), float(np.sqrt(error / test[0, 0])), float(1 - error / spread) if spread > 0 else None, uncentred(w, centre).tolist()))
    kind = data.schema[fold].dataType.simpleString()
    return rows.sparkSession.createDataFrame(made, f"model string, `{fold}` {kind}, setting string, n_train long, n_test long, rmse double, r2 double, weights array<double>")


def uncentred(w: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Intercept and coefficients for rows that the centre was not taken off."""
    return np.concatenate([[w[0] + centre[-1] - centre[:-1] @ w[1:]], w[1:]])


def predicted(x: Column, weights: Column) -> Column:
    """Intercept and coefficients applied to an array of features."""
    return weights[0] + F.aggregate(F.zip_with(x, F.slice(weights, F.lit(2), F.size(x)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def sweep(a: np.ndarray, k: int) -> None:
    """Bring feature k into the model, in place; a holds X'X, X'y and y'y."""
    d = a[k, k]
    row = a[k] / d
    a -= np.outer(a[:, k], row)
    a[k], a[:, k] = row, row
    a[k, k] = -1.0 / d


def unsweep(a: np.ndarray, k: int) -> None:
    """Take feature k out of the model again."""
    d = a[k, k]
    row = -a[k] / d
    a += np.outer(a[:, k], row)
    a[k], a[:, k] = row, row
    a[k, k] = -1.0 / d


class Swept:
    """A least squares model of scaled features that drops one feature after another without another look at the rows."""

    def __init__(self, g: np.ndarray):
        self.n, self.mean, self.scale, a, b = standardised(g)
        self.a = np.zeros((len(b) + 1, len(b) + 1))
        self.a[:-1, :-1], self.a[:-1, -1], self.a[-1, :-1] = a, b, b
        self.a[-1, -1] = moments(g)[2][-1, -1]
        first = np.diag(self.a).copy()
        self.inside: list[int] = []
        for k in range(len(b)):
            if first[k] > 0 and self.a[k, k] > ROUNDING * first[k]:  # else a line of those inside
                sweep(self.a, k)
                self.inside.append(k)

    def drop(self, k: int) -> None:
        if k in self.inside:
            unsweep(self.a, k)
            self.inside.remove(k)

    def coefficients(self) -> np.ndarray:
        w = np.zeros(len(self.a) - 1)
        w[self.inside] = self.a[self.inside, -1]
        return w

    def without(self, k: int) -> np.ndarray:
        """The coefficients after dropping k, which stays."""
        w = self.coefficients()
        if k in self.inside:
            w = w - np.where(np.isin(np.arange(len(w)), self.inside), self.a[:-1, k], 0.0) / self.a[k, k] * w[k]
            w[k] = 0.0
        return w

    def weights(self, w: np.ndarray | None = None) -> np.ndarray:
        return _raw(self.mean, self.scale, self.coefficients() if w is None else w)


def recursive_elimination(g: np.ndarray, keep: int) -> list[int]:
    """Drop the feature with the least absolute coefficient on scaled features, the later one of equals, until keep are left."""
    model = Swept(g)
    left = list(range(len(g) - 2))
    while len(left) > keep:
        size = np.abs(model.coefficients())
        worst = min(left, key=lambda k: (size[k], -k))
        model.drop(worst)
        left.remove(worst)
    return left


def backward_selection(parts: dict[int, np.ndarray], keep: int) -> list[int]:
    """Drop the feature without which the mean squared error over held-out parts is least, the first of equals, until keep are left."""
    total = sum(parts.values())
    held = [g for g in parts.values() if 0 < g[0, 0] < total[0, 0]]
    models = [Swept(total - g) for g in held]
    left = list(range(len(total) - 2))
    while len(left) > keep:
        error = {k: np.mean([squared_error(g, m.weights(m.without(k))) / g[0, 0] for g, m in zip(held, models)]) if held else 0.0 for k in left}
        worst = min(left, key=lambda k: (error[k], k))
        for m in models:
            m.drop(worst)
        left.remove(worst)
    return left


def pls_rotations(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, sample deviations, and the weights of k partial least squares components for features scaled by them.

    The target is one column, so each component's direction is what is left of X'y after the ones before took their part
    off; that needs X'X and X'y alone. A component points the way in which its largest weight is positive.
    """
    n, mean, scale, a, b = standardised(g)
    widen = np.sqrt(max(n - 1, 1.0) / max(n, 1.0))
    a, b, weights, loads, turned = a * widen**2, b * widen, [], [], []
    left = b.copy()
    for _ in range(k):
        size = np.linalg.norm(left)
        w = left / size if size > ROUNDING * max(np.linalg.norm(b), 1e-300) else np.zeros(len(b))
        if np.any(w):
            w = w * np.sign(w[np.argmax(np.abs(w))])
        r = w.copy()
        for q, p in zip(turned, loads):
            r -= q * (p @ w)
        t = r @ a @ r
        load = a @ r / t if t > 0 else np.zeros(len(b))
        left = left - load * (r @ b)
        weights.append(w)
        loads.append(load)
        turned.append(r)
    return mean[:-1], scale / widen, np.array(turned).reshape(k, -1)


def pls_scores(rows: DataFrame, key: str, target: str, features: list[str], k: int = 2) -> DataFrame:
    """(key, pls1..plsk): scores of all complete rows on the components of the scaled features that explain the target."""
    data = complete_rows(rows, [key], target, features)
    centre = centre_of(data, len(features))
    found = grams(data.withColumn("_k", F.lit(0)), ["_k"], centre).first()  # one matrix
    if found is None:
        return data.select(key, *[F.lit(0.0).alias(f"pls{i + 1}") for i in range(k)])
    mean, scale, turned = pls_rotations(square(found["gram"], len(features) + 2), k)
    weights = [np.concatenate([[-(r / scale) @ (mean + centre[:-1])], r / scale]).tolist() for r in turned]
    return data.select(key, *[predicted(F.col("_x"), F.array(*[F.lit(v) for v in w])).alias(f"pls{i + 1}") for i, w in enumerate(weights)])
