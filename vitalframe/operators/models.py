"""Grouped evaluation of regression models.

Models of a study fit on few rows and have many settings, so the settings are the unit of work: a bounded sample of
rows is given to every task, each (model, setting, fold) is fitted on its own, and only the errors come together. The
chosen models, whose size the sample bounds, then predict every row of the table where it lies. Where no sample is wanted,
nested_cv fits on every row (operators.whole).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.functions.nulls import clean_num
from vitalframe.kernels.regressors import MODEL_SETS
from vitalframe.operators import whole
from vitalframe.operators.aggregates import regression_errors
from vitalframe.session import cut_lineage

#: Complete rows up to which a table that is fitted as a whole is given to every task.
FEW_ROWS = 4096
#: Rows of a fold, and rows in all, that models are fitted on at most; the rows with the smallest hashes are taken.
FOLD_ROWS = 256


def inner_folds(groups: np.ndarray, k: int) -> np.ndarray:
    """Largest group first to the lightest fold."""
    names, counts = np.unique(groups, return_counts=True)
    load, place = [0] * k, {}
    for i in np.lexsort((np.arange(len(names)), -counts)).tolist():
        f = min(range(k), key=lambda j: (load[j], j))
        load[f] += int(counts[i])
        place[names[i]] = f
    return np.array([place[g] for g in groups])


def _numbers(rows: DataFrame, key: str, target: str, features: list[str], *more: str) -> DataFrame:
    return rows.select(F.col(key).alias("_key"), *more, F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])


def bounded_sample(data: DataFrame, features: list[str], part: str, most_rows: int) -> pd.DataFrame:
    """Complete rows with the smallest hashes of each part, at most most_rows of each, on the driver in a fixed order."""
    whole = data.dropna(subset=["_y", *features])
    first = F.row_number().over(Window.partitionBy(part).orderBy(F.xxhash64("_key", "_y", *features), "_key", "_y", *features))
    return whole.withColumn("_n", first).where(F.col("_n") <= most_rows).drop("_n").toPandas().sort_values([part, "_key", "_y", *features], kind="stable", ignore_index=True)


def fitted_models(data: DataFrame, sample: pd.DataFrame, features: list[str], held: list[int], models: Iterable[str], inner: int, model_set: str) -> dict[tuple[str, int], Callable]:
    """The model of each (family, held-out fold) whose setting has the least mean RMSE over inner grouped folds; a family
    that fails in a fold is absent. Every setting is a row of its own, spread over all tasks."""
    spark, families = data.sparkSession, MODEL_SETS[model_set]
    shared = spark.sparkContext.broadcast(sample)
    jobs = [(m, i, int(h)) for m in models for i in range(len(families[m][1])) for h in held]
    jobs = spark.createDataFrame(jobs, "model string, setting int, held int").repartition(max(1, min(len(jobs), 4 * spark.sparkContext.defaultParallelism)))

    def training(h: int):
        part = shared.value[shared.value["fold"] != h]
        return part[features].to_numpy(float), part["_y"].to_numpy(float), part["_key"].to_numpy()

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for m, i, h in zip(b["model"], b["setting"], b["held"]):
                x, y, groups = training(h)
                fit, grid = MODEL_SETS[model_set][m]
                fold = inner_folds(groups, min(inner, len(np.unique(groups)))) if len(y) else np.zeros(0, int)
                try:
                    each = [float(np.sqrt(np.mean((fit(x[fold != f], y[fold != f], **grid[i])(x[fold == f]) - y[fold == f]) ** 2))) for f in range(fold.max(initial=0) + 1)] if fold.max(initial=0) else [0.0]
                    found.append(float(np.mean(each)))
                except (ValueError, np.linalg.LinAlgError, FloatingPointError):
                    found.append(float("nan"))
            yield b.assign(error=found)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blobs = []
            for m, i, h in zip(b["model"], b["setting"], b["held"]):
                x, y, _ = training(h)
                fit, grid = MODEL_SETS[model_set][m]
                try:
                    blobs.append(cloudpickle.dumps(fit(x, y, **grid[i])) if len(y) else None)
                except (ValueError, np.linalg.LinAlgError, FloatingPointError):
                    blobs.append(None)
            yield b.assign(blob=blobs)[["model", "held", "setting", "blob"]]

    tried = jobs.mapInPandas(errors, "model string, setting int, held int, error double").where(~F.isnan("error"))
    chosen = tried.groupBy("model", "held").agg(F.min_by("setting", F.struct("error", "setting")).alias("setting"))
    rows = chosen.mapInPandas(best, "model string, held int, setting int, blob binary").where("blob IS NOT NULL").collect()
    return {(r["model"], r["held"]): cloudpickle.loads(bytes(r["blob"])) for r in rows}


def predictions(data: DataFrame, found: dict[tuple[str, int], Callable], features: list[str], models: Iterable[str], key: str) -> DataFrame:
    """(model, fold, key, actual, predicted) of every row by the models of its fold; NULL without a model or with a missing feature."""
    shared, names = data.sparkSession.sparkContext.broadcast(cloudpickle.dumps(found)), list(models)
    kind = data.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = cloudpickle.loads(shared.value)
        for b in batches:
            for m in names:
                out = np.full(len(b), np.nan)
                for h in b["fold"].unique():
                    at = np.flatnonzero((b["fold"] == h).to_numpy() & np.isfinite(b[features].to_numpy(float)).all(1))
                    if (m, h) in made and len(at):
                        out[at] = made[m, h](b[features].to_numpy(float)[at])
                yield pd.DataFrame({"model": m, "fold": b["fold"], key: b["_key"], "actual": b["_y"], "predicted": out})

    made = data.mapInPandas(run, f"model string, fold int, `{key}` {kind}, actual double, predicted double")
    return made.withColumn("predicted", F.when(~F.isnan("predicted"), F.col("predicted")))


def nested_cv(rows: DataFrame, folds: DataFrame, key: str, target: str, features: list[str], models: Iterable[str], inner: int = 3, model_set: str = "low_overfit", fold_rows: int | None = FOLD_ROWS) -> DataFrame:
    """(model, fold, key, actual, predicted) for every row, held out from its model, which is tuned on the other folds.

    Models are fitted on at most fold_rows rows of each fold, or with None on every row: tables of up to FEW_ROWS rows are
    given to every task as they are, for larger ones see operators.whole. Every row of the table is predicted.
    """
    models = list(models)
    data = cut_lineage(_numbers(rows.join(folds, key), key, target, features, "fold"))  # read to fit and to predict
    if fold_rows is None:
        count = data.dropna(subset=["_y", *features]).count()
        if count > FEW_ROWS:
            found, near = whole.fitted(data, features, models, inner, MODEL_SETS[model_set])
            made = predictions(data, found, features, [m for m in models if m != "knn"], key)
            if near is None:
                return made
            near = near.select(F.lit("knn").alias("model"), "fold", F.col("_key").alias(key), F.col("_y").alias("actual"), "predicted")
            missing = data.where(~reduce(lambda a, b: a & b, [clean_num(f).isNotNull() for f in features]))
            missing = missing.select(F.lit("knn").alias("model"), "fold", F.col("_key").alias(key), F.col("_y").alias("actual"), F.lit(None).cast("double").alias("predicted"))
            return made.unionByName(near).unionByName(missing)
        fold_rows = max(1, count)
    sample = bounded_sample(data, features, "fold", fold_rows)
    found = fitted_models(data, sample, features, sorted(sample["fold"].unique().tolist()), models, inner, model_set)
    return predictions(data, found, features, models, key)


def evaluated(train: DataFrame, test: DataFrame, key: str, target: str, features: list[str], models: Iterable[str], inner: int = 3, model_set: str = "low_overfit", most_rows: int = 4 * FOLD_ROWS) -> DataFrame:
    """(model, key, actual, predicted) on the test rows: each model tuned by grouped folds and refitted on the training sample."""
    models = list(models)
    data = _numbers(train.withColumn("fold", F.lit(0)), key, target, features, "fold")
    sample = bounded_sample(data, features, "fold", most_rows)
    found = fitted_models(data, sample, features, [1], models, inner, model_set)
    return predictions(_numbers(test.withColumn("fold", F.lit(1)), key, target, features, "fold"), found, features, models, key).drop("fold")


def summary(predictions: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold metrics per model, least mean RMSE first."""
    per_fold = predictions.groupBy("model", "fold").agg(*regression_errors("actual", "predicted"))
    return per_fold.groupBy("model").agg(*[f(m).alias(f"{m}_{n}") for m in ("rmse", "mae", "r2") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).orderBy("rmse_mean")


def leave_one_out_mean(rows: DataFrame, key: str, target: str) -> DataFrame:
    """The baseline of each held-out participant: the mean of everyone else, from totals instead of a cross join."""
    own = rows.groupBy(key).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    total = own.agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    return own.crossJoin(F.broadcast(total)).select(key, F.try_divide(F.col("_ts") - F.col("_s"), F.col("_tn") - F.col("_n")).alias("predicted"))


def ablation(train: DataFrame, test: DataFrame, key: str, target: str, groups: dict[str, list[str]], models: Iterable[str], model_set: str = "low_overfit") -> DataFrame:
    """Test metrics per model for every combination of modalities, each a list of features."""
    from itertools import combinations

    parts = []
    for n in range(1, len(groups) + 1):
        for names in combinations(groups, n):
            found = evaluated(train, test, key, target, [f for g in names for f in groups[g]], models, model_set=model_set)
            parts.append(found.groupBy("model").agg(*regression_errors("actual", "predicted")).withColumn("modalities", F.lit("+".join(names))))
    return reduce(DataFrame.unionByName, parts)
