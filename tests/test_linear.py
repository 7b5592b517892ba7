"""Linear models, selection and processes from Gram matrices, against dense computations on the rows."""

import numpy as np
import pytest

from vitalframe.operators import gaussian as P
from vitalframe.operators import gram as G
from vitalframe.operators import loso as L

FEATURES = ["a", "b", "c", "d"]


def table(n=240, people=12, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 20, 0.1, 3] + [5, 1000, 0, -2]
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=n)
    y = 100 + x[:, 0] * 3 - x[:, 1] * 0.2 + rng.normal(size=n) * 2
    who = rng.integers(0, people, n)
    who[: n // 3] = 0  # one participant holds a third of the rows
    return [(int(w), "F" if k % 2 else "O", k, int(w) % 3, float(t), *map(float, v)) for k, (w, t, v) in enumerate(zip(who, y, x))]


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def df(spark, rows):
    bad = [(1, "F", 9000, 1, None, 1.0, 1.0, 1.0, 1.0), (1, "F", 9001, 1, 5.0, float("nan"), 1.0, 1.0, 1.0), (None, "F", 9002, None, None, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame([*rows, *bad], "who int, session string, n long, part int, y double, a double, b double, c double, d double").repartition(5)


def arrays(rows):
    return np.array([r[5:] for r in rows]), np.array([r[4] for r in rows]), np.array([r[0] for r in rows]), np.array([r[3] for r in rows])


def dense_ridge(x, y, alpha):
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale == 0, 1, scale)
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda v: (v - mean) / scale @ w + y.mean()


def rmse(p, y):
    return float(np.sqrt(np.mean((p - y) ** 2)))


def best_alpha(x, y, part):
    return min(G.ALPHAS, key=lambda a: round(np.mean([rmse(dense_ridge(x[part != k], y[part != k], a)(x[part == k]), y[part == k]) for k in np.unique(part)]), 12))


def test_grams_add_up(df, rows):
    data = G.complete_rows(df, ["part"], "y", FEATURES)
    x, y, _, part = arrays(rows)
    centre = G.centre_of(data, 4)
    assert np.allclose(centre, [*x.mean(0), y.mean()])
    got = {r["part"]: G.square(r["gram"], 6) for r in G.grams(data, ["part"], centre).collect()}
    for k in range(3):
        z = np.column_stack([np.ones(len(x)), x - x.mean(0), y - y.mean()])[part == k]
        assert np.allclose(got[k], z.T @ z)


def test_nested_linear_equals_dense_fits(df, rows):
    x, y, who, part = arrays(rows)
    fold = who % 4
    made = G.nested_linear(df.withColumn("fold", df["who"] % 4), "fold", "part", "y", FEATURES, {"ridge": G.LINEAR["ridge"], "dummy": [{}]}).collect()
    assert {(r["model"], r["fold"]) for r in made} == {(m, f) for m in ("ridge", "dummy") for f in range(4)}
    for r in made:
        out = fold == r["fold"]
        assert (r["n_train"], r["n_test"]) == ((~out).sum(), out.sum())
        if r["model"] == "ridge":
            alpha = best_alpha(x[~out], y[~out], part[~out])
            assert r["setting"] == f"alpha={alpha:g}"
            want = dense_ridge(x[~out], y[~out], alpha)(x[out])
        else:
            want = np.full(out.sum(), y[~out].mean())
        assert abs(r["rmse"] - rmse(want, y[out])) < 1e-6
        assert np.allclose(r["weights"][0] + x[out] @ r["weights"][1:], want)


@pytest.mark.parametrize(("alpha", "l1_ratio"), [(0.01, 1.0), (0.5, 1.0), (0.3, 0.5), (50.0, 1.0)])
def test_elastic_net_meets_its_conditions(rows, alpha, l1_ratio):
    x, y, _, _ = arrays(rows)
    z = np.column_stack([np.ones(len(x)), x, y])
    w = G.elastic_net(alpha, l1_ratio)(z.T @ z)
    s = (x - x.mean(0)) / x.std(0)
    scaled = w[1:] * x.std(0)
    slope = s.T @ (y - y.mean() - s @ scaled) / len(x) - alpha * (1 - l1_ratio) * scaled
    assert np.all(np.abs(slope) <= alpha * l1_ratio + 1e-6) and np.allclose(slope[scaled != 0], alpha * l1_ratio * np.sign(scaled[scaled != 0]), atol=1e-6)
    assert abs(w[0] - (y.mean() - x.mean(0) @ w[1:])) < 1e-8


def test_feature_without_variance(spark):
    df = spark.createDataFrame([(k % 2, k % 3, float(k), 7.0, float(3 * k + 1)) for k in range(30)], "f int, p int, a double, b double, y double")
    made = G.nested_linear(df, "f", "p", "y", ["a", "b"], {"ridge": [{"alpha": 0.0}], "lasso": [{"alpha": 1e-6}]}).collect()
    assert len(made) == 4 and all(abs(r["weights"][2]) < 1e-9 and abs(r["weights"][1] - 3) < 1e-3 for r in made)
    assert G.nested_linear(df.limit(0), "f", "p", "y", ["a", "b"]).collect() == []


def test_leave_one_out_equals_dense_fits(df, rows):
    x, y, who, part = arrays(rows)
    each, summary = L.loso_regression(df, "who", "part", "y", FEATURES)
    got, preds = {r["who"]: r for r in each.collect()}, np.zeros(len(y))
    for w in np.unique(who):
        out = who == w
        alpha = best_alpha(x[~out], y[~out], part[~out])
        preds[out] = dense_ridge(x[~out], y[~out], alpha)(x[out])
        e = preds[out] - y[out]
        want = rmse(preds[out], y[out]), np.abs(e).mean(), 1 - (e**2).sum() / ((y[out] - y[out].mean()) ** 2).sum(), e.mean()
        assert got[w]["alpha"] == alpha and got[w]["n"] == out.sum() and np.allclose([got[w][c] for c in ("rmse", "mae", "r2", "bias")], want)
    s = summary.first()
    assert s["participants"] == len(got) and abs(s["global_rmse"] - rmse(preds, y)) < 1e-8 and abs(s["mean_rmse"] - np.mean([r["rmse"] for r in got.values()])) < 1e-9


def personal(rows, fit, w, known):
    """Predictions of the second session by each method; known are the rows that models were fitted on."""
    own = [r for r in rows if r[0] == w]
    one, two = [r for r in own if r[1] == "F"], [r for r in own if r[1] == "O"]
    y1, y2 = np.array([r[4] for r in one]), np.array([r[4] for r in two])
    p1, p2 = (fit(np.array([r[5:] for r in part])) for part in (one, two))
    ky = np.array([r[4] for r in known])
    return y2, {"residual_personalization": p2 + (y1 - p1).mean(), "baseline_dummy_no_subject_data": np.full(len(y2), ky.mean()), "baseline_dummy_with_s1": np.full(len(y2), np.concatenate([ky, y1]).mean()), "baseline_repeat_s1_glc": np.resize(y1, len(y2))}


def test_personalised_and_locked(df, rows):
    got = {(r["who"], r["method"]): r for r in L.loso_personalised(df, "who", "session", "part", "n", "y", FEATURES, "F", "O").collect()}
    assert {w for w, _ in got} == set(range(12)) and {m for _, m in got} == set(L.METHODS)
    for w in (0, 1, 5):
        known = [r for r in rows if r[0] != w]
        x, y, _, part = arrays(known)
        y2, want = personal(rows, dense_ridge(x, y, best_alpha(x, y, part)), w, known)
        for m, p in want.items():
            assert abs(got[w, m]["rmse"] - rmse(p, y2)) < 1e-6 and abs(got[w, m]["bias"] - (p - y2).mean()) < 1e-6
    known = [r for r in rows if r[0] < 8]
    x, y, _, part = arrays(known)
    fit = dense_ridge(x, y, best_alpha(x, y, part))
    locked = {(r["who"], r["method"]): r for r in L.locked_test(df.where("who < 8"), df.where("who >= 8"), "who", "session", "part", "n", "y", FEATURES, "F", "O").collect()}
    assert {w for w, _ in locked} == {8, 9, 10, 11}
    for w in (8, 11):
        y2, want = personal(rows, fit, w, known)
        assert all(abs(locked[w, m]["mae"] - np.abs(p - y2).mean()) < 1e-6 for m, p in want.items())
    assert L.method_summary(df.sparkSession.createDataFrame(list(locked.values()))).count() == 4


def coefficients(x, y):
    z = (x - x.mean(0)) / x.std(0)
    return np.linalg.lstsq(z, y - y.mean(), rcond=None)[0]


def test_selection_equals_repeated_fits(df, rows):
    x, y, who, part = arrays(rows)
    got = {r["who"]: r for r in L.loso_selection(df, "who", "part", "y", FEATURES, 2).collect()}
    back = {r["who"]: r for r in L.loso_selection(df, "who", "part", "y", FEATURES, 2, "sbs").collect()}
    assert len(got) == len(back) == 12
    for w in np.unique(who):
        out = who == w
        left = [0, 1, 2, 3]
        while len(left) > 2:
            size = np.abs(coefficients(x[~out][:, left], y[~out]))
            left.pop(int(np.argmin(size)))
        assert got[w]["chosen"] == [FEATURES[k] for k in left]
        e = dense_ridge(x[~out][:, left], y[~out], 0.0)(x[out][:, left]) - y[out]
        assert abs(got[w]["mse"] - (e**2).mean()) < 1e-6
        xs, ys, ps, left = x[~out], y[~out], part[~out], [0, 1, 2, 3]
        while len(left) > 2:
            loss = lambda cols: np.mean([np.mean((dense_ridge(xs[ps != k][:, cols], ys[ps != k], 0.0)(xs[ps == k][:, cols]) - ys[ps == k]) ** 2) for k in np.unique(ps)])
            left.remove(min(left, key=lambda k: loss([c for c in left if c != k])))
        assert back[w]["chosen"] == [FEATURES[k] for k in left]
    stable = {r["feature"]: r for r in L.selection_stability(L.loso_selection(df, "who", "part", "y", FEATURES, 2)).collect()}
    assert stable["a"]["stable"] and sum(r["count"] for r in stable.values()) == 24
    with pytest.raises(ValueError):
        L.loso_selection(df, "who", "part", "y", FEATURES, 2, "mi")


def test_sweeping_a_line_of_others():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    x = np.column_stack([x, x[:, 0] + x[:, 1], np.full(50, 2.0)])
    y = x[:, 0] - 2 * x[:, 2]
    z = np.column_stack([np.ones(50), x, y])
    model = G.Swept(z.T @ z)
    assert model.inside == [0, 1, 2] and np.allclose(z[:, :-1] @ model.weights(), y)
    before = model.without(1)
    model.drop(1)
    assert np.allclose(before, model.coefficients()) and np.allclose(z[:, :-1] @ model.weights(), y)
    assert set(G.recursive_elimination(z.T @ z, 2)) == {0, 2}


def test_process_equals_dense_posterior(df, rows):
    grid = {"count": 48, "kernels": (np.inf, 2.5), "lengths": (1.0, 3.0), "noises": (0.1, 1.0)}
    data = L._sessions(df, "who", "session", "part", "n", "y", FEATURES, "F", "O")
    process = P.Process(data, "part", 4, **grid)
    got = {r["who"]: r for r in P.loso_process(df, "who", "session", "part", "n", "y", FEATURES, "F", "O", **grid).collect()}
    x, y, who, _ = arrays(rows)
    second = np.array([r[1] == "O" for r in rows])
    phi = process.map(x)
    for w in (0, 3, 7):
        out = (who == w) & second
        a, t = phi[~out], y[~out]
        weights = np.linalg.solve(a.T @ a + process.noise * np.eye(48), a.T @ (t - t.mean()))
        assert abs(got[w]["rmse"] - rmse(phi[out] @ weights + t.mean(), y[out])) < 1e-5
        assert (got[w]["n_s1"], got[w]["n_s2"]) == (((who == w) & ~second).sum(), out.sum())
    locked = {r["who"]: r for r in P.locked_process(df.where("who < 8"), df.where("who >= 8"), "who", "session", "part", "n", "y", FEATURES, "F", "O", **grid).collect()}
    assert set(locked) == {8, 9, 10, 11}


@pytest.mark.parametrize("smoothness", P.KERNELS)
def test_features_approach_the_kernel(smoothness):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 2))
    phi = P.feature_map(smoothness, 1.5, np.zeros(2), np.ones(2), count=20_000)(x)
    r = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) / 1.5
    s3, s5 = np.sqrt(3) * r, np.sqrt(5) * r
    want = {np.inf: np.exp(-(r**2) / 2), 1.5: (1 + s3) * np.exp(-s3), 2.5: (1 + s5 + s5**2 / 3) * np.exp(-s5)}[smoothness]
    assert np.abs(phi @ phi.T - want).max() < 0.04
    assert P.posterior(1.0)(np.diag([2.0, 1.0, 1.0, 4.0])).tolist() == [0.0, 0.0, 0.0]
