"""Whitening against exact whole-number covariance."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from vitalframe.llm import whitening as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, size, seed=5):
    rng = random.Random(seed)
    mix = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(size)]
    out = []
    for _ in range(n):
        own = [rng.gauss(0, 3.0 / (k + 1)) for k in range(size)]
        out.append([float(np.float32(sum(a * b for a, b in zip(own, row)) + 9)) for row in mix])
    return out


def exact(rows):
    """x, n, S and the covariance as floats of exact fractions."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, size = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(size)]
    v = [[float(Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n)) for j in range(size)] for i in range(size)]
    return np.array(x), n, np.array(s), np.array(v)


def test_equals_exact_covariance(spark):
    rows = vectors(400, 7)
    made = [(i, v, 0) for i, v in enumerate(rows)]
    bad = [(900, None, 0), (901, [1.0, None] + [0.0] * 5, 0), (902, [float("nan")] * 7, 0), (903, [float("inf")] + [0.0] * 6, 0), (904, [], 0), (905, [1.0, 2.0], 0), (906, [1e30] * 7, 0)]
    made += [*bad, (None, rows[3], 0), (5, rows[5], 1)]
    docs = spark.createDataFrame(made, SCHEMA).repartition(5).selectExpr("*", "'z' AS x", "1 AS component")
    got = op.whiten(docs, most=4).collect()
    x, n, s, v = exact([*rows, rows[3], rows[5]])
    assert len(got) == 4 * n == 4 * 402
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1], vecs[:, ::-1]
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    for k in range(1, 5):
        own = {r["vec_id"]: r for r in got if r["component"] == k and r["vec_id"] is not None}
        want = ((x - s / n) @ vecs[:, k - 1]) / math.sqrt(values[k - 1])
        sign = np.sign(own[0]["whitened"] * want[0])
        assert all(abs(own[i]["whitened"] - sign * want[i]) < 1e-6 for i in range(400))
        assert all(abs(r["explained"] - values[k - 1] / np.trace(v)) < 1e-9 for r in own.values())
        assert all(r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s)) for i, r in own.items())
    assert sum(r["vec_id"] is None for r in got) == 4 and sum(r["vec_id"] == 5 for r in got) == 8


def test_covariance_keeps_what_doubles_lose(spark):
    rng = random.Random(1)
    x = [[10**12 + rng.randrange(1000), 10**12 - rng.randrange(3), rng.randrange(10**9)] for _ in range(3000)]
    n = len(x)
    s = [sum(r[k] for r in x) for k in range(3)]
    df = spark.createDataFrame([(r,) for r in x], "x array<long>").repartition(6)
    high, low = op.covariance(df, "x", n, op.mean_of(np.array(s, object).astype(np.int64), n))
    for i in range(3):
        for j in range(3):
            want = Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n)
            scale = math.sqrt(high[i, i] * high[j, j])
            assert abs(float(Fraction(high[i, j]) + Fraction(low[i, j]) - want)) <= 1e-24 * scale


def test_split_sums_and_products_are_exact():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=500) * 10.0 ** rng.integers(-8, 8, 500), rng.normal(size=500)
    for op_, plain in ((op.two_sum, lambda p, q: p + q), (op.two_product, lambda p, q: p * q)):
        h, e = op_(a, b)
        assert all(Fraction(x) + Fraction(y) == plain(Fraction(p), Fraction(q)) for x, y, p, q in zip(h.tolist(), e.tolist(), a.tolist(), b.tolist()))
    h, e = op.total((a, np.zeros(500)))
    assert abs(Fraction(float(h)) + Fraction(float(e)) - sum(map(Fraction, a.tolist()))) < Fraction(1, 10**18)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0)]])
def test_nothing_to_whiten(spark, rows):
    made = op.whiten(spark.createDataFrame(rows, SCHEMA))
    assert made.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and made.collect() == []


def test_without_variance(spark):
    got = op.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got) == [(i, k, 0, 0.0, 0.0, 0.0) for i in (1, 2) for k in (1, 2)]
    got = op.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 2.0], 0)], SCHEMA)).collect()
    assert sorted((r["component"], abs(r["whitened"]), r["explained"]) for r in got) == [(1, 1.0, 1.0)] * 2 + [(2, 0.0, 0.0)] * 2 and got[0]["identity_error"] < 1e-12
