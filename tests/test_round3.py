"""Faults found in round 3: small tables on which the queries were wrong before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalframe.kernels import registry
from vitalframe.operators import gaussian, gram, loso, signals, stats
from vitalframe.plans import catalog


def test_long_customer_numbers_keep_their_digits(spark, tmp_path):
    rows = [(k, "Machinery") for k in (0, 7, 123, 9999, 10000, 1234567)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    made = {r["c_custkey"]: r["name"] for r in catalog.queries()["id_normalise"](spark, str(tmp_path)).collect()}
    assert made == {0: "hu_00", 7: "hu_07", 123: "hu_123", 9999: "hu_9999", 10000: "hu_10000", 1234567: "hu_1234567"}


def test_zero_is_a_sign_of_its_own_in_the_query(spark, tmp_path):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate([1.0, 0.0, 2.0, -1.0])] + [("g", 0, 3.0)], "file_id string, i long, x double")
    assert {r["file_id"]: r["zcr"] for r in signals.sign_steps(df).collect()} == {"f": 3 / 4, "g": None}
    rows = [(k, k, 1, v, "click") for k, v in enumerate([60.0, 50.0, 70.0, 40.0])]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert catalog.queries()["zero_crossing"](spark, str(tmp_path)).first()["zcr"] == 0.75


def test_features_whose_scores_differ_by_rounding_tie():
    relevance = {"qty": 2.0 * (1 + 1e-13), "line": 2.0, "zebra": 2.0 * (1 - 1e-13), "tax": 1.0}
    assert stats.select_mrmr(relevance, {("qty", "line"): 1.0, ("line", "zebra"): 1.0, ("qty", "zebra"): 1.0}, 2, stats.ROUNDING) == ["zebra", "tax"]
    assert stats.select_mrmr({"a": 2.0 * (1 + 1e-6), "b": 2.0}, {}, 1, stats.ROUNDING) == ["a"]


@pytest.fixture
def studied(spark):
    """Twelve participants of two sessions, some with rows enough to span batches."""
    rng = np.random.default_rng(5)
    rows = [(w, "FO"[k % 2], w % 3, 100 * w + k, *rng.normal(size=3).tolist()) for w in range(12) for k in range(4 + 9 * (w == 7))]
    return spark.createDataFrame([(*r, r[4] - r[5] + w * 0.1) for w, r in enumerate(rows)], "who long, session string, part long, n long, a double, b double, c double, y double")


def test_process_streams_persons(spark, studied, monkeypatch):
    grid = {"count": 8, "kernels": (np.inf,), "lengths": (1.0,), "noises": (1.0,)}
    args = (studied, "who", "session", "part", "n", "y", ["a", "b", "c"], "F", "O")
    process = gaussian.Process(data := loso._sessions(*args), "part", 3, **grid)
    want = {r["who"]: np.array(r["weights"]) for r in gaussian._by_person(process, data, "who", "session", "O", 1).collect()}
    plan = gaussian._by_person(process, data, "who", "session", "O", 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan  # a person's matrix is never spread over rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    monkeypatch.setattr(gaussian, "SOLVED", 2)
    try:
        got = {r["who"]: np.array(r["weights"]) for r in gaussian._by_person(process, data, "who", "session", "O", 1).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(range(12)) and all(np.allclose(got[w], want[w]) for w in want)


def test_kernels_send_files_on_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    sent = []

    class Waves:  # the rows of one Arrow batch, as Spark hands them to the kernel
        schema = {"file_id": type("F", (), {"dataType": type("T", (), {"simpleString": lambda self: "long"})()})()}

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            rows = [[float(k)] * 100 for k in range(9)] + [None]
            sent.extend(run([pa.RecordBatch.from_arrays([pa.array(range(10), pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["file_id", "samples"])]))

    monkeypatch.setattr(registry, "HELD", 250)
    registry.register_kernel("signal", "test_halved", lambda x, fs: x[:50] / 2)
    try:
        registry.process(Waves(), "signal", "test_halved", 60.0)
    finally:
        registry.PIPELINES.pop(("signal", "test_halved"))
    assert [b.num_rows for b in sent] == [5, 5]
    rows = [r for b in sent for r in b.to_pylist()]
    assert [r["file_id"] for r in rows] == list(range(10)) and rows[3]["samples"] == [1.5] * 50 and rows[9]["samples"] == []


def test_stacked_ridges_equal_single_fits():
    rng = np.random.default_rng(3)
    z = [np.column_stack([np.ones(9), x := rng.normal(size=(9, 2)), x[:, 0] * 2, np.full(9, 4.0), rng.normal(size=9)]) for _ in range(12)]
    parts = np.array([m.T @ m for m in z]).reshape(4, 3, 6, 6)
    parts[3, 1] = 0  # a part that a participant filled alone
    best, w = gram.tuned_ridges(parts, list(gram.ALPHAS))
    fits = [gram.ridge(a) for a in gram.ALPHAS]
    for k, mine in enumerate(parts):
        assert best[k] == gram.tuned(dict(enumerate(mine)), fits) and np.allclose(w[k], fits[best[k]](mine.sum(axis=0)))


def test_small_matrices_are_plain_sums(spark, studied):
    data = gram.complete_rows(studied, ["who"], "y", ["a", "b", "c"])
    made = gram.grams(data, ["who"], np.zeros(4))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInPandas" not in plan
    rows = [r for r in studied.collect() if r["who"] == 7]
    z = np.array([[1.0, r["a"], r["b"], r["c"], r["y"]] for r in rows])
    assert np.allclose(gram.square(made.where("who = 7").first()["gram"], 5), z.T @ z)


def test_information_of_tied_points_looks_at_few_others():
    from vitalframe.kernels.information import Plane, digamma
    from vitalframe.operators.information import Tiles, strip_cuts

    assert abs(digamma(np.array([10**12]))[0] - np.log(1e12)) < 1e-12  # no table of that length
    rng = np.random.default_rng(3)
    n = 6000
    for levels in (1, 2, 40):  # ties that are parted by next to nothing, in one, two and forty bands
        x, y = rng.integers(0, levels, n) + 1e-10 * rng.random(n), rng.normal(size=n)
        reach = (tree := Plane(x, y)).nearest(3)[:, 2]
        want = np.sort(np.maximum(np.abs(x[:300, None] - x), np.abs(y[:300, None] - y)), axis=1)[:, 3]
        assert (reach[:300] == want).all()
        leaves, _ = tree._leaves(x, y, reach)
        points = np.stack([x, y], 1)
        tiles = Tiles.of(points, 200)
        own, (p, tile) = tiles.own(points), tiles.touched(points, reach)
        assert np.bincount(own).max() <= 200 and len(leaves) < 6 * n and len(p) < 1.5 * n
        far = [(i, t) for i in range(0, n, 60) for t in np.unique(own[np.maximum(np.abs(x - x[i]), np.abs(y - y[i])) < reach[i]])]
        assert set(far) <= set(zip(p.tolist(), tile.tolist()))
        strips = np.searchsorted(strip_cuts(x, 4000), x, side="right")
        assert levels == 1 or all(len(set(strips[x.round() == band])) == 1 for band in range(levels))  # bands stay whole


def test_a_query_is_sent_once_to_each_bundle_of_cells(spark):
    from pyspark.sql import functions as F

    from vitalframe.operators import neighbours as N

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, rng.normal(size=5).tolist(), float(k)) for k in range(300)], "_id long, _v array<double>, _y double").repartition(2)
    asked, everywhere = df.withColumn("_bound", F.lit(float("inf"))), lambda cells: (lambda n: lambda b, far: [np.arange(n)] * len(b))(len(cells.size))
    one = N.Cells(df)
    assert len(one.size) > 10 and one.looking(asked, everywhere(one)).count() == 300  # not a row for each of its cells
    assert one.compared(one.looking(asked.where("_id < 9"), everywhere(one)), 4).count() == 36
    many = N.Cells(df, block=40)
    looks = many.looking(asked, everywhere(many))
    assert looks.count() == 300 * len(set(many.bundle)) and looks.where("_cells IS NOT NULL").isEmpty()


def test_quantiles_of_few_values_need_no_order(spark, monkeypatch):
    from vitalframe.operators import ordering

    asked = []
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: asked.append(df) or df)
    df = spark.createDataFrame([(g, float(k % 4)) for g in "ab" for k in range(4001)], "g string, v double")
    got = ordering.exact_quantiles(df, "v", [0.5, 0.9], ["g"], most=100)
    assert "Window [row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert len(asked) == 1 and {(r["g"], r["share"]): r["quantile"] for r in got.collect()} == {(g, s): v for g in "ab" for s, v in ((0.5, 1.0), (0.9, 3.0))}


def test_rows_of_equal_bins_are_added_up_once(spark, monkeypatch):
    from vitalframe.operators import trees

    kept = []
    keep = trees.cut_lineage
    monkeypatch.setattr(trees, "cut_lineage", lambda df: kept.append(keep(df)) or kept[-1])
    rows = [(k, float(k % 3), float(k % 2), float(k % 3 * 10 + k % 2)) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    model = trees.fit_forest(df, "id", "y", ["a", "b"], trees=3, depth=3)
    assert len(kept) == 1 and kept[0].count() == 6  # for all trees and levels
    wrong = {(r["y"], round(r["p"], 6)) for r in model.predict(df, "p").collect() if abs(r["p"] - r["y"]) > 1e-9}
    assert not wrong


def test_rank_correlations_sort_the_rows_once_and_match_plain_ranks(spark):
    from vitalframe.operators import ordering

    rng = np.random.default_rng(18)
    n = 900
    y = rng.normal(size=n)
    y[:300], y[300:360:2], y[301:360:2] = 7.5, 0.0, -0.0  # a heavy value, and zeros of both signs
    a, b, c = rng.integers(0, 6, n).astype(float), y + rng.normal(size=n), np.full(n, 2.0)
    rows = [(k % 13 if k % 17 else None, None if k % 23 == 5 else float("nan") if k % 23 == 6 else float(y[k]), float(a[k]), None if k % 5 == 0 else float(b[k]), float(c[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "who long, y double, a double, b double, c double").withColumn("none", F.lit(None).cast("double"))
    ranks = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    made = {r["feature"]: r for r in stats.characterised(df, "who", "y", ["a", "b", "c", "none"]).collect()}
    assert set(made) == {"a", "b", "c"} and made["c"]["spearman"] is None and made["c"]["centered"] is None
    for name, at in (("a", 2), ("b", 3)):
        pairs = [(r[0], r[1], r[at]) for r in rows if r[1] is not None and not np.isnan(r[1]) and r[at] is not None]
        q, x = np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs])
        assert made[name]["spearman"] == pytest.approx(np.corrcoef(ranks(x), ranks(q))[0, 1], abs=1e-12)
        assert made[name]["n_unique"] == len({r[at] for r in rows if r[at] is not None})
        dx, dy = x.copy(), q.copy()
        for w in {p[0] for p in pairs}:
            own = np.array([p[0] == w for p in pairs])
            dx[own] -= x[own].mean()
            dy[own] -= q[own].mean()
        assert made[name]["centered"] == pytest.approx(np.corrcoef(dx, dy)[0, 1], abs=1e-12)
    plan = stats.characterised(df, "who", "y", ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [w.split("specifiedwindowframe")[0] for w in plan.split("windowspecdefinition(")[1:]]
    assert not any("who#" in w for w in windows)  # no window sends the rows to their subjects
    assert ordering.rank_correlations(df.where("y = 7.5"), "y", ["a"]).first()["spearman"] is None


def test_wave_kernels_are_dealt_to_all_cores_and_share_their_steps(spark, tmp_path, monkeypatch):
    from vitalframe.kernels import features, filters, pulses

    x = np.sin(2 * np.pi * 1.2 * np.arange(600) / 60.0) + 0.1 * np.sin(np.arange(600))
    rows = spark.createDataFrame([(k, x[k : k + 64].tolist(), 0) for k in range(64)], "vec_id long, embedding array<float>, label int")
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("ppg_features", "fiducial_points", "wave_savgol"):
        made = catalog.queries()[name](spark, str(tmp_path))
        parts = [r["n"] for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("file_id").alias("n")).collect()]
        assert len(parts) >= spark.sparkContext.defaultParallelism and sum(parts) == 64
    used = []
    for module, name in ((filters, "bandpass"), (pulses, "well_shaped")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name: used.append(_n) or _f(*a))
    features.ppg_features(x + 1e-3, 60.0)
    assert used.count("well_shaped") == 1 and used.count("bandpass") <= 2  # the wave, and the cropped wave


def test_cubic_spline_matches_a_dense_solution():
    from vitalframe.kernels import filters

    rng = np.random.default_rng(23)
    x = np.cumsum(rng.uniform(0.2, 3.0, 40))
    y, at = rng.normal(size=40), np.linspace(x[0], x[-1], 301)
    # Piecewise cubics: values at both ends, equal slopes and curvatures inside, equal third derivatives at the outer knots.
    h, n = np.diff(x), 39
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0
    for k in range(n):
        a[row, 4 * k], b[row] = 1, y[k]
        a[row + 1, 4 * k : 4 * k + 4], b[row + 1] = h[k] ** np.arange(4), y[k + 1]
        row += 2
    for k in range(n - 1):
        a[row, 4 * k + 1 : 4 * k + 4], a[row, 4 * k + 5] = (1, 2 * h[k], 3 * h[k] ** 2), -1
        a[row + 1, 4 * k + 2 : 4 * k + 4], a[row + 1, 4 * k + 6] = (2, 6 * h[k]), -2
        row += 2
    for k in (0, n - 2):
        a[row, 4 * k + 3], a[row, 4 * k + 7] = 1, -1
        row += 1
    c = np.linalg.solve(a, b).reshape(n, 4)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 1)
    want = sum(c[k, p] * (at - x[k]) ** p for p in range(4))
    assert np.allclose(filters.cubic_spline(x, y, at), want, atol=1e-9)


def test_nested_cv_reads_its_rows_once_and_orders_only_the_nearest(spark, monkeypatch):
    from vitalframe.kernels import regressors
    from vitalframe.operators import models, splits

    rng = np.random.default_rng(27)
    x, y = rng.integers(0, 5, (90, 3)).astype(float), rng.normal(size=90)
    z = rng.integers(0, 5, (70, 3)).astype(float)
    for p in (1, 2):
        gap = np.abs(z[:, None] - x[None])
        gap = gap.sum(2) if p == 1 else np.sqrt((gap**2).sum(2))
        assert np.array_equal(regressors.distances(z, x, p), gap)
        for k in (1, 4, 7):
            assert np.array_equal(regressors.nearest_places(gap, k), np.argsort(gap, axis=1, kind="stable")[:, :k])
    gap[3, :] = gap[4, 1:] = np.inf  # fewer finite distances than places
    assert np.array_equal(regressors.nearest_places(gap, 4), np.argsort(gap, axis=1, kind="stable")[:, :4])
    df = spark.createDataFrame([(k % 9, *map(float, x[k]), float(y[k])) for k in range(90)], "g long, a double, b double, c double, y double")
    made = models.nested_cv(df, splits.group_folds(df, "g", 3), "g", "y", ["a", "b", "c"], ["dummy", "knn"])
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()  # the rows are joined to their folds once
    monkeypatch.setattr(np, "argsort", None)
    assert regressors.knn(x, y, k=3)(z).shape == (70,)
