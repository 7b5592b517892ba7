"""Regression models on one task's rows, in NumPy. A fit takes (x, y, settings) and returns the prediction function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Fit = Callable[..., Callable[[np.ndarray], np.ndarray]]


def dummy(x: np.ndarray, y: np.ndarray, how: str = "mean"):
    level = float(np.mean(y) if how == "mean" else np.median(y))
    return lambda z: np.full(len(z), level)


def _standardised(fit):
    def run(x: np.ndarray, y: np.ndarray, *a, **k):
        m, s = x.mean(0), x.std(0)
        s[s == 0] = 1
        f = fit((x - m) / s, y, *a, **k)
        return lambda z: f((z - m) / s)

    return run


@_standardised
def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0):
    c = y.mean()
    w = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ (y - c))
    return lambda z: z @ w + c


@_standardised
def lasso(x: np.ndarray, y: np.ndarray, alpha: float = 0.1, rounds: int = 500):
    """Coordinate descent on half the mean squared error plus alpha times the absolute weights."""
    n, c = len(y), y.mean()
    w, r, norm = np.zeros(x.shape[1]), y - c, (x**2).sum(0) / len(y)
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(norm):
            old = w[j]
            g = x[:, j] @ r / n + norm[j] * old
            w[j] = np.sign(g) * max(abs(g) - alpha, 0) / norm[j]
            r -= x[:, j] * (w[j] - old)
            moved = max(moved, abs(w[j] - old))
        if moved < 1e-7:
            break
    return lambda z: z @ w + c


@_standardised
def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, l1_ratio: float = 0.5, rounds: int = 500):
    """Coordinate descent on half the mean squared error plus alpha times the mixed penalty."""
    n, c = len(y), y.mean()
    w, r, norm = np.zeros(x.shape[1]), y - c, (x**2).sum(0) / len(y)
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(norm):
            old = w[j]
            g = x[:, j] @ r / n + norm[j] * old
            w[j] = np.sign(g) * max(abs(g) - alpha * l1_ratio, 0) / (norm[j] + alpha * (1 - l1_ratio))
            r -= x[:, j] * (w[j] - old)
            moved = max(moved, abs(w[j] - old))
        if moved < 1e-7:
            break
    return lambda z: z @ w + c


def _reweighted(x: np.ndarray, y: np.ndarray, weigh: Callable[[np.ndarray], np.ndarray], alpha: float, rounds: int = 100) -> np.ndarray:
    """Ridge lines with an intercept whose rows are weighted again by their residuals, until the line stays."""
    a = np.column_stack([np.ones(len(x)), x])
    pull = np.diag([0.0] + [alpha] * x.shape[1])
    w = np.linalg.lstsq(a, y, rcond=None)[0]
    for _ in range(rounds):
        k = weigh(y - a @ w)
        new = np.linalg.solve(a.T @ (a * k[:, None]) + pull + 1e-10 * np.eye(a.shape[1]), a.T @ (k * y))
        if np.abs(new - w).max() < 1e-8 * (1 + np.abs(w).max()):
            return new
        w = new
    return w


@_standardised
def huber(x: np.ndarray, y: np.ndarray, epsilon: float = 1.35, alpha: float = 1e-4):
    """Squared loss within epsilon robust deviations of the line, linear beyond."""

    def weigh(r: np.ndarray) -> np.ndarray:
        scale = 1.4826 * np.median(np.abs(r - np.median(r))) or 1.0
        return np.minimum(1.0, epsilon * scale / np.maximum(np.abs(r), 1e-12))

    w = _reweighted(x, y, weigh, alpha)
    return lambda z: z @ w[1:] + w[0]


@_standardised
def median_line(x: np.ndarray, y: np.ndarray, alpha: float = 1.0):
    """Least absolute deviations with an absolute penalty, both by reweighting; alpha counts per row."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.linalg.lstsq(a, y, rcond=None)[0]
    for _ in range(100):
        k = 0.5 / np.maximum(np.abs(y - a @ w), 1e-6)
        pull = np.diag(np.concatenate([[0.0], alpha * len(y) / np.maximum(np.abs(w[1:]), 1e-6)]))
        new = np.linalg.solve(a.T @ (a * k[:, None]) + pull + 1e-10 * np.eye(a.shape[1]), a.T @ (k * y))
        if np.abs(new - w).max() < 1e-7 * (1 + np.abs(w).max()):
            break
        w = new
    return lambda z: z @ w[1:] + w[0]


@_standardised
def consensus(x: np.ndarray, y: np.ndarray, min_samples: float = 0.5, max_trials: int = 100, residual_threshold: float = 10.0, seed: int = 42):
    """The ridge line, of max_trials random ones, that most rows lie near, fitted again to these rows."""
    rng, n = np.random.default_rng(seed), max(2, int(np.ceil(min_samples * len(y))))
    line = lambda at: np.linalg.solve(*(lambda a: (a.T @ a + np.diag([0.0] + [1.0] * x.shape[1]) + 1e-10 * np.eye(a.shape[1]), a.T @ y[at]))(np.column_stack([np.ones(len(at)), x[at]])))
    best, near = (-1, 0.0), np.arange(len(y))
    for _ in range(max_trials):
        w = line(rng.choice(len(y), min(n, len(y)), replace=False))
        gap = np.abs(y - x @ w[1:] - w[0])
        inside = np.flatnonzero(gap <= residual_threshold)
        score = (len(inside), -float(gap[inside].sum()))
        if len(inside) and score > best:
            best, near = score, inside
    w = line(near)
    return lambda z: z @ w[1:] + w[0]


@_standardised
def relevance_line(x: np.ndarray, y: np.ndarray, threshold_lambda: float = 1e4, rounds: int = 300):
    """Bayesian line with a precision of its own for each weight; weights above threshold_lambda are pruned (ARD)."""
    c = y.mean()
    t, keep = y - c, np.ones(x.shape[1], bool)
    precision, noise, w = np.ones(x.shape[1]), 1.0 / (t.var() or 1.0), np.zeros(x.shape[1])
    for _ in range(rounds):
        a = x[:, keep]
        cover = np.linalg.inv(noise * a.T @ a + np.diag(precision[keep]))
        own = noise * cover @ a.T @ t
        gamma = 1 - precision[keep] * np.diag(cover)
        precision[keep] = (gamma + 2e-6) / (own**2 + 2e-6)
        noise = (len(t) - gamma.sum() + 2e-6) / (((t - a @ own) ** 2).sum() + 2e-6)
        new = np.zeros_like(w)
        new[keep] = own
        keep &= precision < threshold_lambda
        if not keep.any() or np.abs(new - w).sum() < 1e-3:
            w = np.where(keep, new, 0.0)
            break
        w = new
    return lambda z: z @ w + c


def distances(z: np.ndarray, x: np.ndarray, p: int) -> np.ndarray:
    """From each row of z to each of x; column by column, so that no array of differences of all columns is held."""
    total = np.zeros((len(z), len(x)))
    for j in range(x.shape[1]):
        gap = z[:, j, None] - x[None, :, j]
        total += np.abs(gap) if p == 1 else gap * gap
    return total if p == 1 else np.sqrt(total)


def nearest_places(gap: np.ndarray, k: int) -> np.ndarray:
    """The first k places of each row in stable order of distance: k times the first least one, without ordering the rest."""
    if k > 16 or not np.isfinite(gap).all():
        return np.argsort(gap, axis=1, kind="stable")[:, :k]
    left, rows = gap.copy(), np.arange(len(gap))
    near = np.empty((len(gap), k), np.intp)
    for i in range(k):
        near[:, i] = left.argmin(1)
        left[rows, near[:, i]] = np.inf
    return near


@_standardised
def knn(x: np.ndarray, y: np.ndarray, k: int = 5, p: int = 2, weights: str = "uniform"):
    def predict(z: np.ndarray) -> np.ndarray:
        out = []
        for part in np.array_split(z, max(1, len(z) * len(x) // 100_000)):
            gap = distances(part, x, p)
            near = nearest_places(gap, min(k, len(y)))
            if weights == "uniform":
                out.append(y[near].mean(1))
            else:  # by inverse distance; rows at distance zero alone where there are any
                d = np.take_along_axis(gap, near, axis=1)
                v = np.where((d == 0).any(1, keepdims=True), d == 0, 1.0 / np.maximum(d, 1e-300))
                out.append((v * y[near]).sum(1) / v.sum(1))
        return np.concatenate(out) if out else np.zeros(0)

    return predict


def covariance(a: np.ndarray, b: np.ndarray, kernel: str, length: float) -> np.ndarray:
    """Squared-exponential (rbf) or Matern kernels of smoothness 3/2 and 5/2."""
    square = np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0.0) / length**2
    if kernel == "rbf":
        return np.exp(-0.5 * square)
    r = np.sqrt(square) * np.sqrt({"matern32": 3.0, "matern52": 5.0}[kernel])
    return (1 + r) * np.exp(-r) if kernel == "matern32" else (1 + r + r**2 / 3) * np.exp(-r)


@_standardised
def gaussian_process(x: np.ndarray, y: np.ndarray, kernel: str = "rbf", length: float = 5.0, alpha: float = 1.0):
    """Posterior mean on the normalised target; alpha is the noise added to the covariance."""
    c, s = y.mean(), y.std() or 1.0
    weight = np.linalg.solve(covariance(x, x, kernel, length) + alpha * np.eye(len(x)), (y - c) / s)

    def predict(z: np.ndarray) -> np.ndarray:
        parts = np.array_split(z, max(1, len(z) * len(x) // 100_000))  # each stays in the cache
        return np.concatenate([covariance(part, x, kernel, length) @ weight * s + c for part in parts])

    return predict


@_standardised
def tuned_process(x: np.ndarray, y: np.ndarray, kernel: str = "rbf", alpha: float = 0.1):
    """A Gaussian process whose length scale and amplitude have the largest marginal likelihood on a fixed grid."""
    c, s = y.mean(), y.std() or 1.0
    t, best = (y - c) / s, None
    for length in np.logspace(-1, 2, 10):
        base = covariance(x, x, kernel, length)
        for size in (0.01, 0.1, 1.0, 10.0, 100.0):
            root = np.linalg.cholesky(size * base + alpha * np.eye(len(x)))
            half = np.linalg.solve(root, t)
            gain = -0.5 * half @ half - np.log(np.diag(root)).sum()
            if best is None or gain > best[0]:
                best = (gain, length, size)
    _, length, size = best
    weight = np.linalg.solve(size * covariance(x, x, kernel, length) + alpha * np.eye(len(x)), t)
    return lambda z: size * covariance(z, x, kernel, length) @ weight * s + c


@_standardised
def kernel_svr(x: np.ndarray, y: np.ndarray, kernel: str = "rbf", c: float = 1.0, epsilon: float = 0.1, gamma: float | str = "scale", degree: int = 3, coef0: float = 0.0, rounds: int = 300):
    """Support vector regression by accelerated projected gradient on the dual, whose coefficients sum to zero."""
    g = 1.0 / (x.shape[1] * (x.var() or 1.0)) if gamma == "scale" else 1.0 / x.shape[1] if gamma == "auto" else gamma
    if kernel == "rbf":
        gram = lambda a, b: np.exp(-g * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0.0))
    else:
        gram = (lambda a, b: (g * a @ b.T + coef0) ** degree) if kernel == "poly" else lambda a, b: a @ b.T
    k, n = gram(x, x), len(y)
    v = np.ones(n)
    for _ in range(30):  # the largest eigenvalue
        v = k @ v
        v /= np.linalg.norm(v) or 1.0
    rate = 1.0 / max(1e-9, 1.05 * float(v @ k @ v))

    def project(u: np.ndarray) -> tuple[np.ndarray, float]:
        """Shrunk by epsilon, boxed by c, and shifted so that the sum is zero."""
        shrink = lambda m: np.clip(np.sign(u - m) * np.maximum(np.abs(u - m) - rate * epsilon, 0), -c, c)
        low, high = u.min() - rate * epsilon - c, u.max() + rate * epsilon + c
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if shrink(mid).sum() > 0 else (low, mid)
        return shrink((low + high) / 2), (low + high) / 2

    beta, ahead, step, shift = np.zeros(n), np.zeros(n), 1.0, 0.0
    for _ in range(rounds):
        new, shift = project(ahead - rate * (k @ ahead - y))
        grown = (1 + np.sqrt(1 + 4 * step**2)) / 2
        ahead, done = new + (step - 1) / grown * (new - beta), np.abs(new - beta).max() < 1e-6 * c
        beta, step = new, grown
        if done:
            break
    return lambda z: gram(z, x) @ beta + shift / rate


def _tree(x: np.ndarray, y: np.ndarray, depth: int, least: int, columns: int | None, rng: np.random.Generator):
    if depth == 0 or len(y) < 2 * least or np.ptp(y) == 0:
        return float(y.mean())
    best = None
    wanted = np.arange(x.shape[1]) if columns is None else rng.choice(x.shape[1], min(columns, x.shape[1]), replace=False)
    for j in wanted.tolist():
        order = np.argsort(x[:, j], kind="stable")
        v, t = x[order, j], y[order]
        left = np.cumsum(t)[:-1]
        n = np.arange(1, len(t))
        gain = left**2 / n + (t.sum() - left) ** 2 / (len(t) - n)
        gain[(v[1:] == v[:-1]) | (n < least) | (len(t) - n < least)] = -np.inf
        i = int(np.argmax(gain))
        if np.isfinite(gain[i]) and (best is None or gain[i] > best[0]):
            best = (gain[i], j, v[i])
    if best is None:
        return float(y.mean())
    side = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[side], y[side], depth - 1, least, columns, rng), _tree(x[~side], y[~side], depth - 1, least, columns, rng)


def _walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    side, out = x[:, tree[0]] <= tree[1], np.empty(len(x))
    out[side], out[~side] = _walk(tree[2], x[side]), _walk(tree[3], x[~side])
    return out


def _columns(width: int, wanted: float | str | None) -> int | None:
    return None if wanted is None else max(1, int(np.sqrt(width))) if wanted == "sqrt" else max(1, int(wanted * width))


def forest(x: np.ndarray, y: np.ndarray, n_estimators: int = 50, max_depth: int | None = 4, min_samples_leaf: int = 5, max_features: float | str | None = None, seed: int = 42):
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(n_estimators):
        pick = rng.integers(0, len(y), len(y))
        grown.append(_tree(x[pick], y[pick], max_depth or 30, min_samples_leaf, _columns(x.shape[1], max_features), rng))
    return lambda z: np.mean([_walk(t, z) for t in grown], axis=0)


def boosting(x: np.ndarray, y: np.ndarray, n_estimators: int = 50, learning_rate: float = 0.05, max_depth: int = 2, min_samples_leaf: int = 1, subsample: float = 1.0, seed: int = 42):
    rng, base = np.random.default_rng(seed), float(y.mean())
    grown, level = [], np.full(len(y), base)
    for _ in range(n_estimators):
        pick = np.arange(len(y)) if subsample >= 1 else rng.choice(len(y), max(1, int(subsample * len(y))), replace=False)
        t = _tree(x[pick], (y - level)[pick], max_depth, min_samples_leaf, None, rng)
        grown.append(t)
        level = level + learning_rate * _walk(t, x)
    return lambda z: base + learning_rate * sum(_walk(t, z) for t in grown)


def _grid(**choices) -> list[dict]:
    """Every combination of the choices, the last name's varying fastest."""
    made: list[dict] = [{}]
    for name, values in choices.items():
        made = [m | {name: v} for m in made for v in values]
    return made


def _log(low: float, high: float, n: int) -> list[float]:
    return [float(v) for v in np.logspace(low, high, n)]


#: The families of each set of models and the grids of their settings. The first set is the one in use.
MODEL_SETS: dict[str, dict[str, tuple[Fit, list[dict]]]] = {
    "low_overfit": {
        "dummy": (dummy, _grid(how=["mean", "median"])),
        "lasso": (lasso, _grid(alpha=_log(-2, 2, 13))),
        "svr": (kernel_svr, _grid(kernel=["linear"], c=[0.03, 0.1, 0.3, 1.0, 3.0], epsilon=[1.0, 2.0, 5.0, 10.0])
                + _grid(kernel=["poly"], degree=[4], c=[0.03, 0.1, 1.0, 3.0], epsilon=[1.0, 5.0], gamma=["scale", 0.003, 0.01, 0.03], coef0=[0.0, 1.0])
                + _grid(kernel=["rbf"], c=[0.03, 0.1, 0.3, 1.0, 3.0], epsilon=[1.0, 2.0, 5.0, 10.0], gamma=["scale", 0.001, 0.003, 0.01, 0.03])),
        "knn": (knn, _grid(k=[1, 3, 5, 7], p=[1, 2])),
        "gpr": (gaussian_process, [{"alpha": a, "kernel": k, "length": s} for a in (0.1, 0.3, 1.0, 3.0, 10.0) for k, s in (("rbf", 5.0), ("rbf", 10.0), ("matern32", 5.0), ("matern52", 10.0))]),
        "rf": (forest, _grid(n_estimators=[10, 30, 50], max_depth=[2, 3, 4], min_samples_leaf=[5, 10, 15], max_features=[0.3, 0.5, "sqrt"])),
        "gbr": (boosting, _grid(n_estimators=[10, 30, 50], learning_rate=[0.01, 0.03, 0.05], max_depth=[1, 2, 3], min_samples_leaf=[5, 10], subsample=[0.5, 0.7])),
    },
    "stable": {
        "dummy": (dummy, _grid(how=["mean", "median"])),
        "ridge": (ridge, _grid(alpha=_log(0, 4, 9))),
    },
    "complex": {
        "dummy": (dummy, _grid(how=["mean", "median"])),
        "ridge": (ridge, _grid(alpha=[0.01, 0.1, 1.0, 10.0, 100.0])),
        "lasso": (lasso, _grid(alpha=_log(-3, 1, 20))),
        "elasticnet": (elastic_net, _grid(alpha=_log(-2, 2, 25), l1_ratio=[0.1, 0.2, 0.5, 0.8, 0.9, 0.95, 1.0])),
        "svr": (kernel_svr, _grid(c=[0.1, 1.0, 10.0], epsilon=[0.01, 0.1, 0.5], gamma=["scale", "auto"])),
        "gpr": (tuned_process, _grid(alpha=[1e-3, 1e-2, 1e-1, 1.0], kernel=["rbf", "matern32", "matern52"])),
        "knn": (knn, _grid(k=[1, 3, 5, 7], weights=["uniform", "distance"])),
        "rf": (forest, _grid(n_estimators=[100, 200], max_depth=[None, 3, 5, 10], min_samples_leaf=[1, 3, 5])),
        "gbr": (boosting, _grid(n_estimators=[100, 200], learning_rate=[0.01, 0.05, 0.1], max_depth=[2, 3, 4])),
        "huber": (huber, _grid(epsilon=[1.1, 1.2, 1.35, 1.5, 2.0], alpha=_log(-5, 1, 7))),
        "quantile": (median_line, _grid(alpha=_log(-5, 1, 10))),
        "ransac": (consensus, _grid(min_samples=[0.5, 0.7, 0.9], max_trials=[100, 300], residual_threshold=[5.0, 10.0, 15.0, 20.0])),
        "ard": (relevance_line, _grid(threshold_lambda=[1e3, 1e4, 1e5])),
    },
}
