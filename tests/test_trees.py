"""Trees by histograms, neighbours by pivots, and quantiles in rounds, against plain computations."""

import numpy as np
import pytest

from vitalframe.operators import neighbours as N
from vitalframe.operators import ordering as O
from vitalframe.operators import trees as T

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 12, 400), rng.normal(size=400).round(1), np.full(400, 3.0)])
    y = np.where(x[:, 0] > 5, 10.0, 0.0) + np.where(x[:, 1] > 0.3, 4.0, 0.0) + rng.normal(size=400)
    return x, y


@pytest.fixture(scope="module")
def df(spark, rows):
    made = [(k, float(t), *map(float, v)) for k, (v, t) in enumerate(zip(*rows))]
    return spark.createDataFrame([*made, (9000, None, 1.0, 1.0, 1.0), (9001, 1.0, None, 1.0, 1.0)], "id long, y double, a double, b double, c double").repartition(4)


def plain_tree(x, y, w, depth, least, allowed, node=1):
    """{node: (feature, threshold)} and {node: (value, weight)} by trying every threshold."""
    values, splits = {node: ((w * y).sum() / w.sum(), w.sum())}, {}
    best = None
    for f in allowed if depth else ():
        for t in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= t
            lw, rw = w[left].sum(), w[~left].sum()
            if lw < least or rw < least:
                continue
            gain = (w * y)[left].sum() ** 2 / lw + (w * y)[~left].sum() ** 2 / rw - (w * y).sum() ** 2 / w.sum()
            if gain > 1e-9 * (w * y * y).sum() and (best is None or gain > best[0] + 1e-9):
                best = gain, f, t
    if best:
        _, f, t = best
        left = x[:, f] <= t
        splits[node] = (f, t)
        for k, part in ((2 * node, left), (2 * node + 1, ~left)):
            s, v = plain_tree(x[part], y[part], w[part], depth - 1, least, allowed, k)
            splits |= s
            values |= v
    return splits, values


def same(tree, splits, values):
    assert set(tree.splits) == set(splits) and all(tree.splits[k][0] == splits[k][0] and abs(tree.splits[k][1] - splits[k][1]) < 1e-12 for k in splits)
    assert set(tree.values) == set(values) and all(np.allclose(tree.values[k], values[k]) for k in values)


@pytest.mark.parametrize(("depth", "least"), [(0, 1), (1, 1), (3, 25)])
def test_tree_equals_plain_search(df, rows, depth, least):
    x, y = rows
    tree = T.fit_tree(df, "y", FEATURES, depth, least, bins=100)
    splits, values = plain_tree(x, y, np.ones(len(y)), depth, least, [0, 1, 2])
    same(tree, splits, values)
    table = {r["node"]: r for r in T.tree_table(df.sparkSession, tree, FEATURES).collect()}
    assert {k for k, r in table.items() if r["feature"]} == set(splits)


def test_boosting_equals_plain_rounds(df, rows):
    x, y = rows
    model = T.fit_boosted(df, "y", FEATURES, rounds=3, depth=2, rate=0.5, bins=100)
    p = np.full(len(y), y.mean())
    for tree in model.trees:
        splits, values = plain_tree(x, y - p, np.ones(len(y)), 2, 1, [0, 1, 2])
        same(tree, splits, values)
        for k in range(len(y)):
            node = 1
            while node in splits:
                f, t = splits[node]
                node = 2 * node + (x[k, f] > t)
            p[k] += 0.5 * values[node][0]
    got = {r["id"]: r["predicted"] for r in model.predict(df.where("id < 400")).collect()}
    assert np.allclose([got[k] for k in range(400)], p)


def test_forest_trees_use_their_rows_and_features(df, rows):
    model = T.fit_forest(df, "id", "y", FEATURES, trees=5, depth=2, share=0.67)
    assert len(model.trees) == 5 and all(len({f for f, _ in t.splits.values()}) <= 2 for t in model.trees)
    weights = [t.values[1][1] for t in model.trees]
    assert len(set(weights)) > 1 and all(300 < w < 500 for w in weights)
    got = {r["id"]: r["predicted"] for r in model.predict(df.where("id < 400")).collect()}
    assert np.corrcoef([got[k] for k in range(400)], rows[1])[0, 1] > 0.6


def test_few_bins_are_quantiles(df):
    from vitalframe.operators.gram import complete_rows

    edges = T.thresholds(complete_rows(df, [], "y", FEATURES), 3, bins=8)
    assert edges[2] == [] and 3 <= len(edges[1]) <= 7 and all(e == sorted(set(e)) for e in edges)
    assert T.fit_tree(df.limit(0), "y", FEATURES, 2).values == {}


@pytest.mark.parametrize("block", [7, 2048])
def test_neighbours_are_exact(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 40
    v = np.vstack([centres[k % 12] + rng.normal(size=6) for k in range(400)])
    v[200:210] = v[0]  # ties
    made = [(k, [float(x) for x in row], float(k % 17)) for k, row in enumerate(v)] + [(999, None, 1.0)]
    df = spark.createDataFrame(made, "id long, e array<double>, y double").repartition(3)
    got = {r["id"]: r["predicted"] for r in N.nearest_neighbours(df, df, "id", "e", "y", 5, block=block).collect()}
    assert len(got) == 400
    for k in range(400):
        gap = N.distances(v[k : k + 1], v)[0]
        near = [j for j in np.lexsort((np.arange(400), gap)) if j != k][:5]
        assert abs(got[k] - np.mean([j % 17 for j in near])) < 1e-9
    assert N.compared_pairs(df, df, "id", "e", "y", 5) < 0.3 * 400 * 400
    few = df.where("id < 3")
    assert {r["id"]: r["predicted"] for r in N.nearest_neighbours(few, few, "id", "e", "y", 5).collect()} == {0: 1.5, 1: 1.0, 2: 0.5}
    assert N.nearest_neighbours(df.limit(0), df.limit(0), "id", "e", "y", 5).collect() == []


def test_quantiles_in_rounds_and_ranks(spark):
    rng = np.random.default_rng(8)
    data = {g: np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n).round(2) * 10) for g, n in (("a", 3000), ("b", 40), ("c", 1))}
    df = spark.createDataFrame([(g, float(v), float(k % 13)) for g, own in data.items() for k, v in enumerate(own)] + [("a", None, 1.0)], "g string, v double, u double").repartition(5)
    shares = [0.0, 0.013, 0.3, 0.5, 0.77, 1.0]
    for most in (4, 1 << 20):
        got = {(r["g"], r["share"]): r["quantile"] for r in O.exact_quantiles(df, "v", shares, ["g"], most).collect()}
        assert set(got) == {(g, s) for g in data for s in shares}
        assert all(abs(got[g, s] - np.quantile(own, s)) < 1e-9 for g, own in data.items() for s in shares)
    every = np.concatenate(list(data.values()))
    assert all(abs(r["quantile"] - np.quantile(every, r["share"])) < 1e-9 for r in O.exact_quantiles(df, "v", shares, most=10).collect())

    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    out = O.average_ranks(df, {"v": "rv", "u": "ru"}, ["g"]).collect()
    for g, own in data.items():
        mine = sorted((r["v"], r["u"], r["rv"], r["ru"]) for r in out if r["g"] == g)
        want = sorted(zip(own, np.arange(len(own)) % 13, ranks(own), ranks(np.arange(len(own)) % 13)))
        assert np.allclose(mine, want)
    whole = sorted((r["v"], r["rv"]) for r in O.average_ranks(df, {"v": "rv"}).collect())
    assert np.allclose(whole, sorted(zip(every, ranks(every))))


def test_long_stretches_are_cut(spark):
    df = spark.createDataFrame([(1, 10), (5, 4), (7, 7)], "a long, b long")
    got = [r["n"] for r in O.each_number(df, df["a"], df["b"], "n", chunk=3).orderBy("a", "n").collect()]
    assert got == [*range(1, 11), 7]


@pytest.mark.parametrize("block", [1 << 15, 40, 150])
def test_information_equals_a_search_over_the_column(spark, block):
    from vitalframe.kernels.information import neighbour_information as plain
    from vitalframe.operators.information import neighbour_information

    rng = np.random.default_rng(9)
    y = rng.normal(size=900)
    y[:3] = [40.0, -30.0, 41.0]  # far points, whose reach leaves any block of x
    sides = {"line": y * 2 + rng.normal(size=900), "steps": np.floor(y * 2), "flag": (rng.random(900) < 0.4) * 1.0, "flat": np.full(900, 2.0), "few": np.where(np.arange(900) < 4, y, np.nan)}
    made = [(n, float(a) if a == a else None, float(b)) for n, x in sides.items() for a, b in zip(x, y)]
    df = spark.createDataFrame(made, "feature string, v double, t double").repartition(4)
    got = {r["feature"]: r["mi"] for r in neighbour_information(df, ["feature"], "v", "t", 3, block).collect()}
    for n, x in sides.items():
        order = np.lexsort((x, y))
        want = plain(x[order], y[order], 3)
        assert np.isnan(want) and got[n] is None or abs(got[n] - want) < 1e-9, n
