"""Models of nested cross-validation that are fitted on every row."""

import numpy as np
import pandas as pd
import pytest

from vitalframe.kernels.regressors import MODEL_SETS, gaussian_process
from vitalframe.operators import models, splits, whole


def plain(data, fold, families, features):
    """Predictions by plain loops: (family, held-out rows, predicted)."""
    for h in sorted(set(fold)):
        part, held = data[fold != h], data[fold == h]
        x, y, groups = part[features].to_numpy(), part["y"].to_numpy(), part["g"].to_numpy()
        inner = models.inner_folds(groups, 3)
        for m in families:
            fit, grid = MODEL_SETS["low_overfit"][m]
            error = [np.mean([np.sqrt(np.mean((fit(x[inner != f], y[inner != f], **s)(x[inner == f]) - y[inner == f]) ** 2)) for f in range(3)]) for s in grid]
            yield m, held, fit(x, y, **grid[int(np.argmin(error))])(held[features].to_numpy())


def test_every_row_is_fitted_and_predicted(spark, monkeypatch):
    """Two hundred more rows a fold than a sample took, with ties, equal rows, an outlier and rows with missing values."""
    monkeypatch.setattr(models, "FEW_ROWS", 0)
    monkeypatch.setattr(whole, "POLYNOMIALS", 300)
    rng, n, features = np.random.default_rng(4), 1400, ["a", "b"]
    x = rng.normal(size=(n, 2))
    x[:, 1] = np.round(x[:, 1], 1)
    x[:140], x[300:330], x[7] = x[140:280], x[300], (9.0, -9.0)
    y = 3 * np.sin(2 * x[:, 0]) + x[:, 1] + 0.3 * rng.normal(size=n)
    data = pd.DataFrame({"g": rng.integers(0, 50, n), "y": y, "a": x[:, 0], "b": x[:, 1]})
    df = spark.createDataFrame(data).unionByName(spark.createDataFrame([(3, 1e9, None, 2.0), (4, None, 0.1, 0.2)], "g long, y double, a double, b double"))
    folds = splits.group_folds(df, "g", 3)
    dealt = {r["g"]: r["fold"] for r in folds.collect()}
    names = ["dummy", "lasso", "knn", "gpr"]
    got = models.nested_cv(df, folds, "g", "y", features, names, fold_rows=None).toPandas()
    assert len(got) == 4 * (n + 2) and got["predicted"].isna().sum() == 4 and got["actual"].isna().sum() == 4
    assert got[got["actual"].isna()]["predicted"].notna().all()
    data["fold"] = data["g"].map(dealt)
    data = data.sort_values(["fold", "g", "y", *features], ignore_index=True)
    for m, held, want in plain(data, data["fold"].to_numpy(), names, features):
        have = got[(got["model"] == m) & got["actual"].notna()].set_index("actual")["predicted"].reindex(held["y"]).to_numpy()
        gap = np.abs(have - want)
        assert np.sqrt(np.mean(gap**2)) < 0.01 * y.std() if m == "gpr" else gap.max() < 1e-8, m


def test_registered_query_uses_all_orders(spark):
    """The baseline is the mean or median of all orders of the other folds, not of 256 of each."""
    from vitalframe.plans import catalog

    got = catalog.queries()["nested_cv"](spark, "/root/testdata/sf0.001").where("model = 'dummy'").toPandas()
    for h in sorted(got["fold"].unique()):
        rest, level = got[got["fold"] != h]["actual"], got[got["fold"] == h]["predicted"].unique()
        assert len(rest) > 1024 and len(level) == 1
        assert min(abs(level[0] - rest.mean()), abs(level[0] - rest.median())) < 1e-6


@pytest.mark.parametrize("kernel, tolerance", [("rbf", 1e-8), ("matern52", 1e-3), ("matern32", 1e-2)])
def test_covariance_as_polynomials(kernel, tolerance):
    """Against the equations of all rows."""
    rng = np.random.default_rng(6)
    x, z = rng.normal(size=(900, 2)), rng.normal(size=(200, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2 + 0.1 * rng.normal(size=900)
    both = np.vstack([x, z])
    poly = whole.Polynomials(both.min(0), both.max(0), 22)
    points = whole.points_of(poly, np.zeros(3), np.ones(2), np.zeros(3))
    v = poly.values(points)
    n, ones, total, gram, first, second = poly.opened(sum(poly.moments(x[k::2], y[k::2], [np.arange(450)])[0] for k in range(2)))
    assert n == 900 and np.allclose(gram, poly.values(x).T @ poly.values(x)) and np.allclose([first, second], [y.sum(), (y**2).sum()])
    c = whole.covariance_of(np.linalg.solve(v.T @ v, v.T), points / x.std(0), kernel, 5.0)
    w = c @ np.linalg.solve(gram @ c + np.eye(len(c)), total - first / n * ones)
    want = gaussian_process(x, y, kernel=kernel, length=5.0, alpha=1.0)(z)
    assert np.abs(whole.process_line(poly, w, first / n)(z) - want).max() < tolerance * want.std()
