"""Cleaning, relevance and redundancy statistics of feature tables.

Column-wise statistics run on the long form (key, feature, value), so one aggregation serves any number of features and
no plan grows with the width of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.functions.nulls import clean_num, safe_corr, to_number
from vitalframe.operators.information import neighbour_information
from vitalframe.operators.ordering import exact_quantiles, rank_correlations

#: Scores that differ by no more than this share are equal but for the rounding of sums; and the most rows whose sums one
#: task takes in the rows' order. Above, sums of tasks are merged in any order, so their last digits must decide nothing.
ROUNDING, IN_ORDER = 1e-8, 1 << 17


def long_form(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, value) with every value a double."""
    return rows.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keys, features, "feature", "value")


def problem_report(rows: DataFrame, features: list[str]) -> DataFrame:
    """Per column: rows, NaN or NULL or text, either infinity, their sum and share, and the valid rest. Text is coerced."""
    text = rows.select(*[F.col(f).cast("string").alias(f) for f in features]).unpivot([], features, "feature", "raw")
    v = F.col("raw").try_cast("double")
    inf = float("inf")
    counts = text.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v.isNull() | F.isnan(v)).alias("n_nan"), F.count_if(v == inf).alias("n_pos_inf"), F.count_if(v == -inf).alias("n_neg_inf"))
    return counts.withColumn("n_bad", F.col("n_nan") + F.col("n_pos_inf") + F.col("n_neg_inf")).withColumn("share_bad", F.col("n_bad") / F.col("n")).withColumn("n_valid", F.col("n") - F.col("n_bad"))


def clean_and_impute(rows: DataFrame, features: list[str], most_bad: float = 0.10, fit_on: DataFrame | None = None) -> DataFrame:
    """Coerce to numbers; drop columns with more than most_bad problems; fill with medians; drop constant columns.

    The statistics come from fit_on (the training rows), or from all rows. They are one row of an aggregate, which the
    driver reads to fix the output's columns.
    """
    source = fit_on if fit_on is not None else rows
    fitted = source.select(*[to_number(f).alias(f) for f in features])
    parts = [x for f in features for x in (F.avg(F.col(f).isNull().cast("double")).alias(f"{f}|bad"), F.min(f).alias(f"{f}|min"), F.max(f).alias(f"{f}|max"))]
    stats = fitted.agg(*parts).first().asDict()
    medians = exact_quantiles(fitted.unpivot([], features, "feature", "value"), "value", [0.5], ["feature"])
    stats |= {f"{f}|median": None for f in features} | {f"{r['feature']}|median": r["quantile"] for r in medians.collect()}
    keep = []
    for f in features:
        bad, median, low, high = (stats[f"{f}|{k}"] for k in ("bad", "median", "min", "max"))
        constant = median is None or low == high and (bad == 0 or median == low)
        if (bad or 0) <= most_bad and not constant:
            keep.append(f)
    others = [c for c in rows.columns if c not in features]
    return rows.select(*others, *[F.coalesce(to_number(f), F.lit(stats[f"{f}|median"])).alias(f) for f in keep])


def scaled(rows: DataFrame, features: list[str], fit_on: DataFrame | None = None, how: str = "z") -> DataFrame:
    """z-scores by population deviation, or min-max scaling, fitted on another table if given; a constant column gives 0."""
    source = fit_on if fit_on is not None else rows
    pair = {"z": (F.avg, F.stddev_pop), "minmax": (F.min, lambda c: F.max(c) - F.min(c))}[how]
    fitted = source.agg(*[f(clean_num(c)).alias(f"_{i}_{c}") for c in features for i, f in enumerate(pair)])
    wide = rows.crossJoin(F.broadcast(fitted))  # the aggregate's one row
    made = {c: F.when(F.col(f"_1_{c}") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_0_{c}")) / F.col(f"_1_{c}")) for c in features}
    return wide.withColumns(made).drop(*fitted.columns)


def paired_values(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature_1, feature_2, x, y) of each row for every pair of features that both have a value.

    Pairs come from an array of the row's own values, so the plan grows with the number of features, not of pairs, and
    rows are never joined with each other.
    """
    names = F.array(*[F.lit(f) for f in features])
    values = rows.select(F.array(*[clean_num(f) for f in features]).alias("v"))
    first = values.select("v", F.posexplode("v").alias("i", "x")).where("x IS NOT NULL")
    second = first.select("i", "x", F.posexplode("v").alias("j", "y")).where("j > i AND y IS NOT NULL")
    return second.select(names[F.col("i")].alias("feature_1"), names[F.col("j")].alias("feature_2"), "x", "y")


def feature_pairs(rows: DataFrame, features: list[str]) -> DataFrame:
    """For every pair of features: correlation, least squares line, and how the two differ, in one aggregation; partial
    aggregation leaves one row per pair in each task."""
    both, x, y = paired_values(rows, features), F.col("x"), F.col("y")
    return both.groupBy("feature_1", "feature_2").agg(
        safe_corr("x", "y").alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.max(F.abs(x - y)).alias("max_difference"),
        F.avg(F.abs(x - y)).alias("mean_difference"), F.avg((x == y).cast("double")).alias("share_equal"), F.avg((x == -y).cast("double")).alias("share_negated"), F.count(F.lit(1)).alias("n"))


def near_duplicate_pairs(pairs: DataFrame, least: float = 0.95) -> DataFrame:
    return pairs.where(F.abs("r") >= least)


def affine_pairs(rows: DataFrame, pairs: DataFrame, features: list[str], tolerance: float = 1e-10, relative: bool = False) -> DataFrame:
    """Pairs whose second feature is a line of the first, by the largest residual, which may be taken in deviations of the
    second feature; lines are few and joined by pair name."""
    lines = pairs.where("slope IS NOT NULL").select("feature_1", "feature_2", "slope", "intercept")
    long = paired_values(rows, features)
    residual = F.max(F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")))
    return long.join(F.broadcast(lines), ["feature_1", "feature_2"]).groupBy("feature_1", "feature_2").agg((F.try_divide(residual, F.stddev_pop("y")) if relative else residual).alias("max_residual")).withColumn("affine", F.col("max_residual") < tolerance)


def variance_components(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One-way random-effects decomposition and intraclass correlation; NULL below two groups or without residual freedom."""
    v = clean_num(value)
    groups = rows.where(v.isNotNull()).groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s2"))
    t = groups.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("s2")).alias("ssw"), F.avg("n").alias("size"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("ssb"))
    fine = (F.col("k") >= 2) & (F.col("total") > F.col("k"))
    t = t.withColumn("msb", F.when(fine, F.try_divide("ssb", F.col("k") - 1))).withColumn("msw", F.when(fine, F.try_divide("ssw", F.col("total") - F.col("k"))))
    t = t.withColumn("between", F.when(fine, F.greatest(F.try_divide(F.col("msb") - F.col("msw"), F.col("size")), F.lit(0.0))))
    return t.select("k", "total", "msb", "msw", "between", F.try_divide("between", F.col("between") + F.col("msw")).alias("icc"), (F.try_divide("msw", F.col("between") + F.col("msw")) * 100).alias("within_pct"))


def centered(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each column less its mean within the key."""
    w = Window.partitionBy(key)
    return rows.withColumns({c: clean_num(c) - F.avg(clean_num(c)).over(w) for c in columns})


def variance_by_feature(long: DataFrame, subject: str) -> DataFrame:
    """icc and within_pct of each feature of a long table, as variance_components gives them."""
    return _parted(long.groupBy("feature", subject).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("s2")), subject)


def _parted(groups: DataFrame, subject: str, *more: Column) -> DataFrame:
    """icc and within_pct of each feature from the number, mean and variance of its values by subject; and more aggregates."""
    whole = (F.col("n") > 0) & F.col(subject).isNotNull()
    n, m, s2 = (F.when(whole, F.col(c)) for c in ("n", "m", "s2"))
    t = groups.groupBy("feature").agg(
        F.count(n).alias("_k"), F.sum(n).alias("_total"), F.sum(n * s2).alias("_ssw"), F.avg(n).alias("_size"), (F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum(n)).alias("_ssb"), *more)
    fine = (F.col("_k") >= 2) & (F.col("_total") > F.col("_k"))
    within = F.when(fine, F.try_divide("_ssw", F.col("_total") - F.col("_k")))
    between = F.when(fine, F.greatest(F.try_divide(F.try_divide("_ssb", F.col("_k") - 1) - within, F.col("_size")), F.lit(0.0)))
    t = t.withColumn("icc", F.try_divide(between, between + within)).withColumn("within_pct", F.try_divide(within, between + within) * 100)
    return t.drop("_k", "_total", "_ssw", "_size", "_ssb")


def characterised(rows: DataFrame, subject: str, target: str, features: list[str]) -> DataFrame:
    """Per feature: Pearson, Spearman, within-subject and repeated-measures correlation with the target, moments, missing
    percentage, distinct values, intraclass correlation and the share of variance within subjects.

    Correlations within subjects come from the subjects' own covariances, so no row is sorted or sent for them.
    """
    rows = rows.select(subject, *[clean_num(c).alias(c) for c in (target, *features)])
    long = long_form(rows, [subject, target], features)
    x, y = F.when(F.col(target).isNotNull(), F.col("value")), F.when(F.col("value").isNotNull(), F.col(target))
    n = F.count(x)
    related = long.groupBy("feature").agg(
        n.alias("_pairs"), safe_corr("value", target).alias("pearson"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), (F.avg(F.col("value").isNull().cast("double")) * 100).alias("missing_pct"),
        F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurt"))
    groups = long.groupBy("feature", subject).agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("s2"), n.alias("_both"), F.covar_pop(x, y).alias("_xy"), F.var_pop(x).alias("_xx"), F.var_pop(y).alias("_yy"))
    part = lambda c: F.sum(F.col("_both") * F.col(c))
    inner = _parted(groups, subject, F.try_divide(part("_xy"), F.sqrt(part("_xx")) * F.sqrt(part("_yy"))).alias("centered"), F.count_if((F.col("_both") > 0) & F.col(subject).isNotNull()).alias("k"))
    made = related.where("_pairs > 0").drop("_pairs").join(inner, "feature").join(rank_correlations(rows, target, features), "feature")
    return made.withColumn("rm_corr", F.when(F.col("k") >= 3, F.col("centered"))).withColumn("cv", F.when(F.abs("mean") > 1e-8, F.col("std") / F.abs("mean"))).drop("k")


def judged_features(rows: DataFrame, subject: str, target: str, features: list[str], k: int = 3) -> DataFrame:
    """The characteristics with the target's mutual information, the composite score and the interpretation, best first."""
    made = characterised(rows, subject, target, features).join(neighbour_relevance(rows, target, features, k), "feature", "left").withColumn("mi", F.when(~F.isnan("mi"), F.col("mi")))
    made = made.withColumn("composite_score", composite_score("rm_corr", "centered", "pearson", "spearman", "mi"))
    return made.withColumn("interpretation", interpretation("missing_pct", "n_unique", "icc", "within_pct", "rm_corr", "centered", "pearson")).orderBy(F.desc("composite_score"))


def composite_score(rm, centred, pearson, spearman, mi) -> Column:
    """Weighted absolute relevance; mutual information is scaled to its range over the table; missing parts count 0."""
    part = lambda c: F.coalesce(F.abs(F.col(c)), F.lit(0.0))
    w = Window.partitionBy()  # one row per feature
    scaled_mi = F.coalesce(F.try_divide(F.col(mi) - F.min(mi).over(w), F.max(mi).over(w) - F.min(mi).over(w)), F.lit(0.0))
    return 0.30 * part(rm) + 0.25 * part(centred) + 0.20 * part(pearson) + 0.15 * part(spearman) + 0.10 * scaled_mi


def interpretation(missing, unique, icc, within, rm, centred, pearson) -> Column:
    """The first rule that a feature meets; a missing correlation counts 0, a missing share meets no rule."""
    r, c, p = (F.coalesce(F.abs(F.col(x)), F.lit(0.0)) for x in (rm, centred, pearson))
    i, w = F.col(icc), F.col(within)
    # The thresholds and labels of the rules.
    return (
        F.when(F.col(missing) >= 40, "High missingness").when(F.col(unique) <= 3, "Low-resolution / near-constant feature")
        .when((i >= 0.75) & (r < 0.2) & (c < 0.2), "Mostly subject-specific").when((r >= 0.3) & (w >= 50), "Dynamic biomarker")
        .when((r >= 0.3) & (i >= 0.5), "Dynamic with strong subject baseline").when((p >= 0.3) & (c < 0.15) & (i >= 0.6), "Mostly between-subject association")
        .otherwise("Mixed behavior"))


def equal_frequency_edges(rows: DataFrame, value: str, bins: int) -> list[float]:
    """Distinct quantiles that bound at most `bins` buckets."""
    found = exact_quantiles(rows.select(clean_num(value).alias("v")), "v", [k / bins for k in range(bins + 1)])
    return sorted({r["quantile"] for r in found.collect()})


def bucketed(value, edges: list[float]) -> Column:
    """The 0-based bucket of a value: the number of inner edges that it exceeds or meets."""
    total = F.lit(0)
    for e in edges[1:-1]:
        total = total + (F.col(value) >= e).cast("int")
    return total


def conditional_information(rows: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """I(X; Y | Z) of discrete columns from their joint counts, whose number the products of levels bounds."""
    joint = rows.groupBy(x, y, z).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = lambda *keys: F.sum("n").over(Window.partitionBy(*keys))
    terms = joint.select((F.col("n") / total()).alias("p"), (F.col("n") * total(z) / (total(x, z) * total(y, z))).alias("ratio"))
    return terms.agg(F.sum(F.col("p") * F.ln(F.col("ratio") + 1e-12)).alias("cmi"))


def select_mrmr(relevance: dict[str, float], redundancy: dict[tuple[str, str], float], k: int, rounding: float = 0.0) -> list[str]:
    """Greedy minimum redundancy, maximum relevance: the next feature has the largest ratio of relevance to the mean
    absolute correlation with those chosen; of scores that differ by a share of at most `rounding`, as those of a feature
    and a line of it, the last name. Runs on the driver over statistics of features, never over rows."""
    chosen: list[str] = []
    left = sorted(relevance)
    between = lambda a, b: abs(redundancy.get((a, b), redundancy.get((b, a), 0.0)) or 0.0)
    while left and len(chosen) < k:
        score = lambda f: relevance[f] / max(sum(between(f, c) for c in chosen) / len(chosen), 1e-3) if chosen else relevance[f]
        scores = {f: score(f) for f in left}
        best = max(f for f in left if scores[f] >= max(scores.values()) * (1 - rounding))
        chosen.append(best)
        left.remove(best)
    return chosen


def mrmr(rows: DataFrame, target: str, features: list[str], k: int) -> list[str]:
    """mRMR with F-test relevance; reads one row per feature and per pair."""
    long = long_form(rows, [target], features).where("value IS NOT NULL")
    found = long.groupBy("feature").agg(safe_corr("value", target).alias("r"), F.count("value").alias("n")).collect()
    relevance = {r["feature"]: (r["r"] or 0.0) ** 2 / max(1e-12, 1 - (r["r"] or 0.0) ** 2) * max(1, r["n"] - 2) for r in found}
    pairs = {(r["feature_1"], r["feature_2"]): r["r"] for r in feature_pairs(rows, features).collect()}
    return select_mrmr(relevance, pairs, k, ROUNDING if max((r["n"] for r in found), default=0) > IN_ORDER else 0.0)


def relevance_report(rows: DataFrame, target: str, features: list[str], k: int = 3) -> DataFrame:
    """Per feature the correlation with the target, its absolute value and the mutual information, most informative first."""
    long = long_form(rows, [target], features)
    found = long.groupBy("feature").agg(safe_corr("value", target).alias("r")).join(neighbour_relevance(rows, target, features, k), "feature")
    return found.withColumn("abs_r", F.abs("r")).orderBy(F.desc("mi"), F.desc("abs_r"))


def information_matrix(rows: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """(feature_1, feature_2, mi) for every pair of features."""
    return neighbour_information(paired_values(rows, features), ["feature_1", "feature_2"], "x", "y", k)


def reduced_features(train: DataFrame, features: list[str], least: float = 0.95, tolerance: float = 1e-10) -> tuple[list[str], DataFrame]:
    """The statistics driver: features that are no line of an earlier one, and the report on all highly correlated pairs."""
    rows = train.select(*features)
    close = near_duplicate_pairs(feature_pairs(rows, features), least)
    lines = affine_pairs(rows, close, features, tolerance, relative=True)  # as on scaled features
    report = close.join(lines, ["feature_1", "feature_2"], "left")
    gone = {r["feature_2"] for r in lines.where("affine").select("feature_2").distinct().collect()}  # names of features
    return [f for f in features if f not in gone], report


def identical_pairs(rows: DataFrame, features: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Per pair of features: whether they are equal, close or each other's negation, mean, largest and deviation of the
    absolute difference, and the percentage of equal values; missing ones are skipped."""
    x, y = F.col("x"), F.col("y")
    gap = F.abs(x - y)
    return paired_values(rows, features).groupBy("feature_1", "feature_2").agg(
        F.bool_and(x == y).alias("equal"), F.bool_and(gap <= tolerance * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))).alias("close"), F.bool_and(x == -y).alias("negated"),
        F.avg(gap).alias("mean_difference"), F.max(gap).alias("max_difference"), F.stddev_pop(gap).alias("std_difference"), (F.avg((x == y).cast("double")) * 100).alias("equal_pct"))


def statistics_report(train: DataFrame, target: str, features: list[str], least: float = 0.95, k: int = 3) -> dict[str, DataFrame]:
    """The statistics driver on training rows: scaled features, their correlations, the highly correlated pairs with how
    far they are identical and whether one is a line of the other, and the features' relevance to the target."""
    rows = scaled(train, features)
    pairs = feature_pairs(rows, features)
    close = near_duplicate_pairs(pairs, least)
    lines = affine_pairs(rows, close, features, relative=True)
    redundant = close.select("feature_1", "feature_2", "r").join(identical_pairs(train, features), ["feature_1", "feature_2"]).join(lines, ["feature_1", "feature_2"], "left")
    return {"scaled": rows, "correlations": pairs, "redundant": redundant, "relevance": relevance_report(rows, target, features, k)}


def chosen_variance(train: DataFrame, chosen: list[str], subject: str) -> DataFrame:
    """(feature, icc, within_pct) of the selected features, as the selection driver reports them."""
    return variance_by_feature(long_form(train, [subject], chosen).withColumn("value", clean_num("value")), subject)


def selected_features(train: DataFrame, test: DataFrame, target: str, features: list[str], k: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """The selection driver: drop lines of other features, choose k by mRMR on the training rows alone, and cut both tables
    to the chosen features and all columns that are no features. k below 1 keeps every feature that is left."""
    left, _ = reduced_features(train, features)
    chosen = mrmr(train, target, left, k) if k > 0 else left  # correlations do not depend on the features' scales
    others = [c for c in train.columns if c not in features]
    return train.select(*chosen, *others), test.select(*chosen, *[c for c in others if c in test.columns]), chosen


def neighbour_relevance(rows: DataFrame, target: str, features: list[str], k: int = 3) -> DataFrame:
    """(feature, mi): mutual information of each feature with the target."""
    long = long_form(rows.withColumn(target, F.col(target).cast("double")), [target], features)
    return neighbour_information(long, ["feature"], "value", target, k)


def principal_components(rows: DataFrame, key: str, features: list[str], k: int = 2) -> DataFrame:
    """Scores on the first k principal components of the scaled features; the covariance is one aggregation."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    made = VectorAssembler(inputCols=features, outputCol="_v").transform(scaled(rows.select(key, *[F.col(f).cast("double").alias(f) for f in features]).dropna(), features))
    scores = PCA(k=k, inputCol="_v", outputCol="_p").fit(made).transform(made).withColumn("_p", vector_to_array("_p"))
    return scores.select(key, *[F.col("_p")[i].alias(f"pc{i + 1}") for i in range(k)])
