"""Relational operators on hand-made tables."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from vitalframe.functions import nulls, scalars
from vitalframe.operators import aggregates, joins, models, neighbours, ordering, segments, signals, splits, stats

NAN, INF = float("nan"), float("inf")


def quality(spark, *files):
    rows = [(f"f{k}", i, q) for k, qs in enumerate(files) for i, q in enumerate(qs)]
    return spark.createDataFrame(rows, "file_id string, i long, q double")


def triples(df):
    return sorted((r["file_id"], r["start_sample"], r["duration"], round(r["quality_indicator"], 6)) for r in df.collect())


def test_runs(spark):
    q = quality(spark, [0.6, 0.7, 0.1, 0.9, 0.8, 0.7], [0.9, NAN, 0.9], [0.1], [None, 0.5])
    assert triples(segments.threshold_runs(q, 0.5)) == [("f0", 0, 2, 0.65), ("f0", 3, 3, 0.8), ("f1", 0, 1, 0.9), ("f1", 2, 1, 0.9), ("f3", 1, 1, 0.5)]
    assert triples(segments.threshold_runs(q, 0.5, fs=2.0, min_seconds=1.2)) == [("f0", 0, 2, 0.65), ("f0", 3, 3, 0.8)]


def test_runs_do_not_depend_on_row_order(spark):
    q = quality(spark, [0.9, 0.2, 0.8, 0.7, 0.1, 0.6])
    assert triples(segments.threshold_runs(q, 0.5)) == triples(segments.threshold_runs(q.orderBy(F.desc("i")).repartition(3), 0.5))


@pytest.mark.parametrize("n, size, shift, want", [(25, 10, 5, 4), (9, 10, 5, 0), (10, 10, 3, 1), (13, 10, 3, 2)])
def test_windows(spark, n, size, shift, want):
    one = spark.createDataFrame([("f", 7, n, 0.5)], "file_id string, start_sample long, duration long, quality_indicator double")
    got = sorted(r["start_sample"] for r in segments.sliding_windows(one, size, shift).collect())
    assert got == [7 + shift * k for k in range(want)]


def test_best_and_complete_and_balanced(spark):
    s = spark.createDataFrame([("f", "a", 0, 0.9), ("f", "a", 5, 0.9), ("f", "b", 0, None), ("g", "a", 0, 0.1)], "file_id string, modality string, start_sample long, quality_indicator double")
    best = {(r["file_id"], r["modality"]): r["start_sample"] for r in segments.best_per(s, ("file_id", "modality")).collect()}
    assert best == {("f", "a"): 0, ("f", "b"): 0, ("g", "a"): 0}
    assert {r["file_id"] for r in segments.complete_groups(s, ("file_id",), ["a", "b"]).collect()} == {"f"}
    assert segments.balanced(s, "file_id", "quality_indicator", "start_sample").count() == 2


def test_numbers_run_over_files(spark):
    s = spark.createDataFrame([("b", 0), ("a", 9), ("a", 2)], "file_id string, start_sample long")
    assert {(r["file_id"], r["start_sample"]): r["segment_id"] for r in segments.numbered(s).collect()} == {("a", 2): "seg_id0", ("a", 9): "seg_id1", ("b", 0): "seg_id2"}


def test_null_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0), (NAN, 4.0), (INF, None), (3.0, 6.0)], "x double, y double")
    assert df.agg(F.avg(nulls.clean_num("x"))).first()[0] == 2.0
    assert abs(df.agg(nulls.safe_corr("x", "y")).first()[0] - 1) < 1e-12 and df.agg(nulls.safe_corr(F.lit(1.0), "y")).first()[0] is None
    assert [r[0] for r in df.select(nulls.row_mean("x", "y")).collect()] == [1.5, 4.0, None, 4.5]
    assert [r[0] for r in df.select(nulls.meets("x", 2)).collect()] == [False, False, True, True]
    assert spark.range(1).select(nulls.safe_div(F.lit(1.0), F.lit(0.0)), nulls.to_number(F.lit("abc"))).first() == (None, None)


def test_fusion_repeats_shorter_lists(spark):
    ppg = spark.createDataFrame([("p", 0, 1.0, 0.2), ("p", 1, 2.0, 0.4), ("p", 2, 3.0, 0.6), ("q", 0, 9.0, 0.1)], "k string, o int, f double, quality_indicator double")
    ecg = spark.createDataFrame([("p", 0, 10.0, 0.4), ("p", 1, 20.0, None)], "k string, o int, f double, quality_indicator double")
    got = sorted((r["k"], r["ppg_f"], r["ecg_f"], round(r["quality_indicator"], 6)) for r in joins.fused_quality(joins.fuse({"ppg": ppg, "ecg": ecg}, ["k"], "o")).collect())
    assert got == [("p", 1.0, 10.0, 0.3), ("p", 2.0, 20.0, 0.4), ("p", 3.0, 10.0, 0.5)]


def test_asof(spark):
    mk = lambda v: spark.createDataFrame([("f", x) for x in v], "file_id string, i long")
    got = [(r["onset"], r["peak"], r["next_onset"]) for r in joins.last_before_first_after(mk([1, 5, 12]), mk([2, 5, 8]), "file_id", "i").collect()]
    assert got == [(2, 5, 8)]
    assert sorted((r["i"], r["next_at"]) for r in joins.next_after(mk([1, 5]), mk([5, 6]), "file_id", "i").collect()) == [(1, 5), (5, 6)]


def test_cleaning(spark):
    rows = [(str(k), "abc" if k == 0 else str(k), INF if k < 3 else 1.0, 7.0) for k in range(10)]
    df = spark.createDataFrame(rows, "id string, a string, b double, c double")
    out = stats.clean_and_impute(df, ["a", "b", "c"])
    assert out.columns == ["id", "a"] and {r["id"]: r["a"] for r in out.collect()}["0"] == 5.0
    report = {r["feature"]: r for r in stats.problem_report(df, ["a", "b", "c"]).collect()}
    assert report["a"]["n_nan"] == 1 and report["b"]["n_pos_inf"] == 3 and report["c"]["n_valid"] == 10


def test_icc_and_one_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 6.0)], "k string, v double")
    r = stats.variance_components(df, "k", "v").first()
    assert math.isclose(r["msb"], 16.0) and math.isclose(r["msw"], 0.5) and math.isclose(r["icc"], 7.75 / 8.25)
    assert stats.variance_components(df.where("k = 'a'"), "k", "v").first()["icc"] is None


def test_pairs_and_mrmr(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k + 1, float((k * 7) % 5), 4.0, float(k) + (k % 3)) for k in range(20)], "a double, b double, c double, d double, y double")
    pairs = {(r["feature_1"], r["feature_2"]): r for r in stats.feature_pairs(df, ["a", "b", "c", "d"]).collect()}
    assert math.isclose(pairs["a", "b"]["r"], 1.0) and pairs["a", "d"]["r"] is None
    assert [(r["feature_1"], r["feature_2"]) for r in stats.affine_pairs(df, stats.feature_pairs(df, ["a", "b", "c"]), ["a", "b", "c"], 1e-8).where("affine").collect()] == [("a", "b")]
    assert len(stats.mrmr(df, "y", ["a", "b", "c"], 2)) == 2
    assert stats.select_mrmr({"a": 5.0, "b": 4.9, "c": 2.0}, {("a", "b"): 1.0, ("a", "c"): 0.1, ("b", "c"): 0.1}, 2) == ["a", "c"]


def test_hampel_and_interpolation(spark):
    x = [1.0, 1.1, 0.9, 50.0, 1.0, 1.1, 0.9, 1.0, 1.2]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(x)], "file_id string, i long, x double")
    out = {r["i"]: r for r in signals.hampel(df, 2, 6.0).collect()}
    assert out[3]["outlier"] and math.isclose(out[3]["fixed"], 0.95) and out[1]["fixed"] == 1.1


def test_signal_counts(spark):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate([1.0, 0.0, -1.0, -1.0, 2.0])], "file_id string, i long, x double")
    assert signals.sign_changes(df).first()["zcr"] == 2 / 5
    e = signals.extrema(spark.createDataFrame([("f", i, v) for i, v in enumerate([0.0, 1.0, 1.0, 0.0, 2.0])], "file_id string, i long, x double")).first()
    assert (e["n_maxima"], e["n_minima"]) == (1, 1)
    g = [r[0] for r in df.withColumn("g", signals.gradient()).orderBy("i").select("g").collect()]
    assert g == [-1.0, -1.0, -0.5, 1.5, 3.0]


def test_splits(spark):
    df = spark.createDataFrame([(k, float(k % 9)) for k in range(100)], "id long, y double")
    parts = {r["id"]: r["part"] for r in splits.hash_split(df, "id", {"train": 0.7, "test": 0.3}).collect()}
    assert len(parts) == 100 and sum(p == "train" for p in parts.values()) == 70
    assert splits.overlapping({"a": df.where("id < 5"), "b": df.where("id >= 5"), "c": df.where("id = 7")}, "id") == [("b", "c")]
    sizes = spark.createDataFrame([(g, n) for g, n in enumerate([5, 4, 3, 3, 2, 1]) for _ in range(n)], "g long, n long")
    folds = {r["g"]: r["fold"] for r in splits.group_folds(sizes, "g", 3).collect()}
    assert folds == {0: 0, 1: 1, 2: 2, 3: 2, 4: 1, 5: 0}


def test_models():
    import numpy as np

    from vitalframe.kernels.regressors import MODEL_SETS

    assert sum(len(grid) for _, grid in MODEL_SETS["low_overfit"].values()) == 416
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 5
    for families in MODEL_SETS.values():
        best = {}
        for name, (fit, grid) in families.items():
            best[name] = min(np.sqrt(np.mean((fit(x[:60], y[:60], **s)(x[60:]) - y[60:]) ** 2)) for s in grid[:: max(1, len(grid) // 12)] + grid[-1:])
        for name in {"ridge", "lasso", "elasticnet", "huber", "quantile", "ransac", "ard"} & set(best):
            assert best[name] < 0.1 * best["dummy"], (name, best)  # the target is linear
        assert all(e < 0.75 * best["dummy"] for name, e in best.items() if name != "dummy"), best  # all learn from sixty rows


def test_vector_regression_meets_its_conditions():
    import numpy as np

    from vitalframe.kernels.regressors import kernel_svr

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = 20 * np.sin(x[:, 0]) + 5 + rng.normal(size=60)
    inside = np.abs(kernel_svr(x, y, kernel="rbf", c=100.0, epsilon=3.0, gamma=0.5, rounds=5000)(x) - y)
    assert inside.max() < 3.3  # a large budget leaves every row within epsilon
    flat = kernel_svr(x, y, kernel="rbf", c=1e-9, epsilon=1.0)(x)
    assert np.ptp(flat) < 1e-3 and y.min() <= flat[0] <= y.max()


@pytest.mark.parametrize("rows", [1000, 20])
def test_nested_cv_matches_plain_loops(spark, rows):
    """Every setting, fold and row by hand; with few rows allowed, on the same sample."""
    import numpy as np

    from vitalframe.kernels.regressors import MODEL_SETS

    rng = np.random.default_rng(2)
    data = [(int(g), float(3 * a + rng.normal()), float(a), float(b)) for g, a, b in zip(rng.integers(0, 20, 150), rng.normal(size=150), rng.normal(size=150))]
    df = spark.createDataFrame([*data, (3, 1.0, None, 2.0)], "g long, y double, a double, b double")
    folds = splits.group_folds(df, "g", 3)
    fold = {r["g"]: r["fold"] for r in folds.collect()}
    got = models.nested_cv(df, folds, "g", "y", ["a", "b"], ["dummy", "lasso", "knn"], fold_rows=rows).collect()
    assert len(got) == 3 * 151 and sum(r["predicted"] is None for r in got) == 3
    sample = models.bounded_sample(models._numbers(df.join(folds, "g"), "g", "y", ["a", "b"], "fold"), ["a", "b"], "fold", rows)
    assert len(sample) == sum(min(rows, sum(fold[g] == f for g, *_ in data)) for f in range(3))
    have = {(r["model"], round(r["actual"], 9)): r["predicted"] for r in got if r["predicted"] is not None}
    for h in range(3):
        part = sample[sample["fold"] != h]
        x, y, groups = part[["a", "b"]].to_numpy(), part["_y"].to_numpy(), part["_key"].to_numpy()
        inner = models.inner_folds(groups, 3)
        for m in ("dummy", "lasso", "knn"):
            fit, grid = MODEL_SETS["low_overfit"][m]
            error = [np.mean([np.sqrt(np.mean((fit(x[inner != f], y[inner != f], **s)(x[inner == f]) - y[inner == f]) ** 2)) for f in range(3)]) for s in grid]
            predict = fit(x, y, **grid[int(np.argmin(error))])
            for g, t, a, b in data:
                if fold[g] == h:
                    assert abs(have[m, round(t, 9)] - predict(np.array([[a, b]]))[0]) < 1e-9


def test_folds_match_the_greedy_rule(spark):
    import random

    rng = random.Random(4)
    for sizes, k in (([rng.choice([1, 1, 2, 3, 7]) for _ in range(60)], 4), ([500, 3, 3, 3, 2, 1, 1, 1, 1], 3), ([5] * 17, 5), ([2, 2], 4)):
        rows = spark.createDataFrame([(g,) for g, n in enumerate(sizes) for _ in range(n)], "g long")
        load, want = [0] * k, {}
        for g in sorted(range(len(sizes)), key=lambda g: (-sizes[g], g)):
            f = min(range(k), key=lambda i: (load[i], i))
            load[f] += sizes[g]
            want[g] = f
        assert {r["g"]: r["fold"] for r in splits.group_folds(rows, "g", k).collect()} == want


def test_ordering(spark):
    import random

    import numpy as np

    rng = random.Random(6)
    values = [rng.choice([1.5, 2.0, 7.0, rng.random()]) for _ in range(400)]
    df = spark.createDataFrame([("a" if i % 3 else "b", v) for i, v in enumerate(values)] + [("a", None)], "k string, v double").repartition(5)
    for share, q in [(r["share"], r["quantile"]) for r in ordering.exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.77, 1.0]).collect()]:
        assert abs(q - np.quantile(values, share)) < 1e-12
    for r in ordering.exact_quantiles(df, "v", [0.25], ["k"]).collect():
        assert abs(r["quantile"] - np.quantile([v for i, v in enumerate(values) if (i % 3 > 0) == (r["k"] == "a")], 0.25)) < 1e-12
    words = spark.createDataFrame([(w,) for w in ("b", "a", "ab", "é", "", "zz", "abcdefgh", "abcdefgi")], "w string")
    got = {r["w"]: r["n"] for r in ordering.running(words, "w", F.lit(1), "n").collect()}
    assert sorted(got, key=got.get) == sorted(got, key=lambda w: w.encode())
    assert ordering.exact_quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_neighbours_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 4))
    v[5] = v[6]
    df = spark.createDataFrame([(i, v[i].tolist(), float(i % 7)) for i in range(90)], "id long, e array<double>, y double")
    got = {r["id"]: r["predicted"] for r in neighbours.nearest_neighbours(df, df, "id", "e", "y", 3, block=20).collect()}
    for i in range(90):
        near = sorted((round(float(np.linalg.norm(v[i] - v[j])), 6), j) for j in range(90) if j != i)[:3]
        assert abs(got[i] - np.mean([j % 7 for _, j in near])) < 1e-12


def test_neighbour_information():
    import numpy as np

    from vitalframe.kernels.information import neighbour_information

    rng = np.random.default_rng(0)
    x, e = rng.normal(size=1500), rng.normal(size=1500)
    y = 0.8 * x + 0.6 * e
    assert abs(neighbour_information(x, y) + 0.5 * np.log(1 - 0.64)) < 0.08 and neighbour_information(x, e) < 0.06
    assert neighbour_information(x, np.ones(1500)) == 0 and np.isnan(neighbour_information(x[:4], y[:4]))


def test_scalars(spark):
    one = spark.createDataFrame([("#007", "./a.csv", " Yes", "x/y.csv")], "a string, b string, c string, d string")
    assert one.select(scalars.participant_name("a"), scalars.numeric_id("a"), scalars.is_plain_filename("b"), scalars.truthy("c"), scalars.is_plain_filename("d")).first() == ("hu_07", 7, True, True, False)
    assert [r[0] for r in spark.range(4).select(scalars.twos_complement("id", 2)).collect()] == [0, 1, -2, -1]
    assert scalars.number_ranges("6,7-10") == [6, 7, 8, 9, 10] and scalars.feature_name("ppg", "s3", "ppg_f0") == "ppg_s3_f0"
    with pytest.raises(ValueError):
        scalars.number_ranges("9-7")


def test_aggregates(spark):
    df = spark.createDataFrame([("p", "m", 1.0), ("p", None, NAN), ("q", "m", 2.0), ("q", "n", 4.0)], "k string, g string, v double")
    got = {r["k"]: r["v"] for r in aggregates.one_vector_per(df, ["k"], ["v"]).collect()}
    assert got == {"p": 1.0, "q": 3.0}
    assert {r["k"] for r in aggregates.conflicting_targets(df, ["k"], "g").collect()} == {"p", "q"}
    with pytest.raises(ValueError):
        aggregates.require_one_target(df, ["k"], "g")
    h = aggregates.histogram(df.where("v = v"), "v", 0.0, 4.0, 4).orderBy("bin").collect()
    assert [r["n"] for r in h] == [0, 1, 1, 1] and h[-1]["cdf"] == 1.0


def test_streaming_runs(spark, tmp_path):
    from vitalframe.streaming import segments as live

    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    spark.createDataFrame([("f", at(s), 0.9 if s not in (3, 4) else 0.1) for s in range(8)], "file_id string, ts timestamp, q double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file_id string, ts timestamp, q double").parquet(str(tmp_path / "in"))
    live.streaming_runs(stream, 0.5, "2 seconds", "0 seconds").writeStream.format("memory").queryName("runs").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["duration"] for r in spark.table("runs").collect()) == [3, 3]
