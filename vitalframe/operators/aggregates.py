"""Aggregations of study tables: per-file and per-measurement vectors, quality statistics, overviews."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.functions.nulls import clean_num, col_of, row_mean
from vitalframe.operators.ordering import exact_quantiles, running, with_neighbour

PERCENTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def one_vector_per(rows: DataFrame, keys: list[str], features: Iterable[str], first: Iterable[str] = (), order: str | None = None) -> DataFrame:
    """The mean of each feature per key, missing values skipped; of the columns in `first` the value of the first row in
    order that has one. One aggregation: no join re-attaches the metadata."""
    keep = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    return rows.groupBy(*keys).agg(*[F.avg(clean_num(c)).alias(c) for c in features], *keep)


def conflicting_targets(rows: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Keys with more than one target value; NULL counts as a value."""
    n = F.count_distinct(target) + F.max(F.when(F.col(target).isNull(), 1).otherwise(0))
    return rows.groupBy(*keys).agg(n.cast("long").alias("n_targets")).where("n_targets > 1")


def require_one_target(rows: DataFrame, keys: list[str], target: str) -> DataFrame:
    """The rows unchanged; raises if a key has several target values."""
    bad = conflicting_targets(rows, keys, target).limit(5).collect()
    if bad:
        raise ValueError(f"several values of {target} for {[tuple(r[k] for k in keys) for r in bad]}")
    return rows


def seconds_per_participant(segments: DataFrame, fs: float, mode: str = "total", participant: str = "participant_id", file: str = "file_id") -> DataFrame:
    """Segment seconds per file, then their sum ('total') or mean ('average') per participant, and the number of files."""
    if mode not in ("total", "average"):
        raise ValueError("mode is total or average")
    per_file = segments.where("duration > 0").groupBy(participant, file).agg((F.sum("duration") / F.lit(float(fs))).alias("_seconds"))
    value = F.sum("_seconds") if mode == "total" else F.avg("_seconds")
    return per_file.groupBy(participant).agg(value.alias("seconds"), F.count(F.lit(1)).alias("n_files"))


def value_stats(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Per key: n, mean, std (population), median, min, max, percentiles, shares of 0.5 and 0.8 of a column."""
    v = clean_num(x)
    plain = rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg((v >= 0.5).cast("double")).alias("share_50"), F.avg((v >= 0.8).cast("double")).alias("share_80"))
    found = exact_quantiles(rows.select(*keys, v.alias("_x")), "_x", list(PERCENTILES), keys)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("share") == p, F.col("quantile"))).alias(f"p{int(p * 100):02d}") for p in PERCENTILES])
    made = plain.join(wide, keys, "left") if keys else plain.crossJoin(F.broadcast(wide))  # one row each
    return made.withColumn("median", F.col("p50"))


def rolled_up(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """value_stats of all keys, of ever fewer from the last on, and of all rows; a key that is summed over is NULL."""
    levels = F.array(*[F.struct(F.lit(k).alias("_level"), *[F.col(c).alias(c) if i < k else F.lit(None).cast(rows.schema[c].dataType).alias(c) for i, c in enumerate(keys)]) for k in range(len(keys) + 1)])
    each = rows.select(F.col(x), F.inline(levels)).withColumn("_group", F.to_json(F.struct("_level", *keys)))  # a missing key is left out, so groups with and without one differ
    names = each.groupBy("_group").agg(*[F.max(c).alias(c) for c in keys])
    return value_stats(each, ["_group"], x).join(names, "_group").drop("_group")


def histogram(rows: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width counts on [low, high], the last bin closed, empty bins included, with the cumulative share."""
    width = (high - low) / bins
    place = F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1)).cast("int")
    counts = rows.where(F.col(x).between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # at most `bins` rows
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return full.select("bin", (F.lit(low) + F.col("bin") * width).alias("edge"), "n", F.least(F.sum("n").over(run) / F.sum("n").over(Window.partitionBy()), F.lit(1.0)).alias("cdf"))


def step_cdf(rows: DataFrame, x: str, key: str | None = None) -> DataFrame:
    """The empirical distribution i / n at each distinct value, overall or per key.

    Values are counted first, so the ordered pass is over distinct values.
    """
    own = [key] if key else []
    counts = rows.groupBy(*own, x).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(*own).agg(F.sum("_n").alias("_total"))
    upto = running(counts, x, "_n", "_upto", own)
    return (upto.join(total, key) if key else upto.crossJoin(F.broadcast(total))).select(*own, x, (F.col("_upto") / F.col("_total")).alias("cdf"))


def pivoted_stats(rows: DataFrame, key: str, modality: str, value: str, modalities: list[str]) -> DataFrame:
    """Mean and population deviation per (key, modality), one row per key; the listed modalities fix the columns."""
    v = clean_num(value)
    aggregates = [f(F.when(F.col(modality) == m, v)).alias(f"sqi_{m}_{n}") for m in modalities for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return rows.groupBy(key).agg(*aggregates, F.count(v).alias("n_segments"))


def combined_rank(stats: DataFrame, columns: list[str], score: str = "sqi_combined", rank: str = "sqi_rank") -> DataFrame:
    """The mean over the modality means that a row has, and its dense rank, best first; without a score no rank.

    Ranks come from the distinct scores, whose number a rounding of the score bounds.
    """
    scored = stats.withColumn(score, row_mean(*columns))
    scores = scored.where(F.col(score).isNotNull()).select((-F.col(score)).alias("_falling")).distinct()
    places = running(scores, "_falling", F.lit(1), rank).select((-F.col("_falling")).alias("_score"), F.col(rank).cast("int").alias(rank))
    return scored.join(places, scored[score] == places["_score"], "left").drop("_score")


def target_stats(rows: DataFrame, keys: list[str], participant: str, target: str) -> DataFrame:
    """Mean and population deviation of the target over distinct measurements."""
    return rows.select(*dict.fromkeys([*keys, participant, target])).distinct().groupBy(participant).agg(
        F.avg(clean_num(target)).alias("target_mean"), F.stddev_pop(clean_num(target)).alias("target_std"))


def overview(rows: DataFrame, keys: list[str], modality: str, modalities: list[str], target: str) -> DataFrame:
    """Rows, rows per modality, and whether the target is consistent, per measurement."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"), *[F.count_if(F.col(modality) == m).alias(f"n_{m}") for m in modalities],
        (F.count_distinct(target) <= 1).alias("consistent"))


def popularity(rows: DataFrame, feature: str, source: str) -> DataFrame:
    """In how many sources each feature is selected, and in which."""
    return rows.select(feature, source).distinct().groupBy(feature).agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"))


def family(feature) -> Column:
    return F.substring_index(col_of(feature), "_", 2)


def stable_features(rows: DataFrame, feature: str, fold: str, least_share: float = 0.5) -> DataFrame:
    """The share of folds that select a feature, where it reaches least_share."""
    folds = rows.agg(F.count_distinct(fold).alias("_folds"))  # one row
    picked = rows.select(feature, fold).distinct().groupBy(feature).agg(F.count(F.lit(1)).alias("_n"))
    return picked.crossJoin(F.broadcast(folds)).select(feature, (F.col("_n") / F.col("_folds")).alias("share")).where(F.col("share") >= least_share)


def amplitude_levels(rows: DataFrame, x: str) -> DataFrame:
    """Distinct levels, the bits they need, the smallest step, whether all steps are equal, and the range."""
    v = clean_num(x)
    levels = rows.select(v.alias("v")).where("v IS NOT NULL").distinct()
    steps = with_neighbour(levels, "v", "before").withColumn("step", F.col("v") - F.col("before"))
    return steps.agg(
        F.count(F.lit(1)).alias("n_levels"), F.ceil(F.log2(F.count(F.lit(1)))).cast("long").alias("bits"), F.min("step").alias("min_step"),
        F.coalesce(F.max("step") - F.min("step") <= 1e-9, F.lit(True)).alias("uniform"), F.min("v").alias("min"), F.max("v").alias("max"))


def summed(columns: list[str]) -> Column:
    """The row's sum over columns, missing ones skipped."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(clean_num(c), F.lit(0.0))
    return total


def regression_errors(actual, predicted) -> list[Column]:
    """rmse, mae, r2 (NULL below two rows or for a constant target) and bias, as aggregates."""
    y, p = clean_num(actual), clean_num(predicted)
    e = p - y
    spread = F.var_pop(y) * F.count(y)
    return [
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when(F.count(e) >= 2, 1 - F.try_divide(F.sum(e * e), spread)).alias("r2"), F.avg(e).alias("bias"),
    ]
