"""Leaving one participant out: fits, personalisation and feature selection by downdating Gram matrices.

Everyone else's matrix is the total less one's own, so a participant's fit needs only two things: the totals, of the
features' size, which every task gets, and the participant's own matrix, which is aggregated like any other. Rows are
read once for the matrices and once for predictions; they are neither copied per participant nor gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.operators import gram as G
from vitalframe.session import cut_lineage

#: The methods that predict a person's second session.
METHODS = ("residual_personalization", "baseline_dummy_no_subject_data", "baseline_dummy_with_s1", "baseline_repeat_s1_glc")


def error_columns(actual: str, predicted: str) -> list[Column]:
    """rmse, mae, r2 and bias (predicted less actual); r2 is NULL below two rows or without variance."""
    e = F.col(predicted) - F.col(actual)
    spread = F.var_pop(actual) * F.count(actual)
    return [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.when(spread > 0, 1 - F.sum(e * e) / spread).alias("r2"), F.avg(e).alias("bias")]


def by_participant(data: DataFrame, participant: str, inner: str, centre: np.ndarray) -> DataFrame:
    """(participant, parts): a participant's own matrices, one for each inner part that the rows fall to."""
    return G.grams(data, [participant, inner], centre).groupBy(participant).agg(F.array_sort(F.collect_list(F.struct(F.col(inner).cast("int").alias("inner"), "gram"))).alias("parts"))


def part_totals(own: DataFrame, size: int) -> dict[int, np.ndarray]:
    """The total matrix of each inner part: at most as many rows as parts times entries reach the driver."""
    each = own.select(F.explode("parts").alias("p")).select("p.inner", F.posexplode("p.gram").alias("at", "v"))
    sums = each.groupBy("inner", "at").agg(F.sum("v").alias("v")).toPandas().sort_values(["inner", "at"])
    return {int(i): G.square(g["v"].to_numpy(), size) for i, g in sums.groupby("inner")}


def left_out(own: DataFrame, participant: str, totals: dict[int, np.ndarray], make: Callable[[dict[int, np.ndarray], np.ndarray], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that make(parts of everyone else, own matrix) gives for each participant, after the participant's column."""
    size = len(next(iter(totals.values()))) if totals else 0
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    kind = own.schema[participant].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for who, parts in zip(b[participant], b["parts"]):
                mine = {p["inner"]: G.square(p["gram"], size) for p in parts}
                rest = {i: g - mine[i] if i in mine else g for i, g in totals.items()}
                if sum(rest.values())[0, 0] > 0.5:
                    out += [(who, *row) for row in make(rest, sum(mine.values()))]
            yield pd.DataFrame(out, columns=[participant, *names])

    return own.mapInPandas(run, f"`{participant}` {kind}, {schema}")


def tuned_models(own: DataFrame, participant: str, totals: dict[int, np.ndarray], centre: np.ndarray, alphas: Iterable[float] = G.ALPHAS) -> DataFrame:
    """(participant, alpha, weights, others_mean): ridge on everyone else, its penalty tuned over inner parts."""
    alphas, names = list(alphas), list(totals)
    every = np.array([totals[i] for i in names])
    kind = own.schema[participant].dataType.simpleString()
    step = max(1, G.HELD // max(1, every.size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low in range(0, len(b), step):
                some = b.iloc[low : low + step]
                rest = np.repeat(every[None], len(some), axis=0)
                for k, parts in enumerate(some["parts"]):
                    for p in parts:
                        rest[k, names.index(p["inner"])] -= G.square(p["gram"], rest.shape[-1])
                there = rest[:, :, 0, 0].sum(axis=1) > 0.5
                if there.any():
                    rest = rest[there]
                    best, w = G.tuned_ridges(rest, alphas)
                    total = rest.sum(axis=1)
                    w[:, 0] += centre[-1] - w[:, 1:] @ centre[:-1]
                    yield pd.DataFrame({participant: some[participant].to_numpy()[there], "alpha": np.array(alphas)[best], "weights": w.tolist(), "others_mean": total[:, 0, -1] / total[:, 0, 0] + centre[-1]})

    return own.mapInPandas(run, f"`{participant}` {kind}, alpha double, weights array<double>, others_mean double")


def loso_regression(rows: DataFrame, participant: str, inner: str, target: str, features: list[str], alphas: Iterable[float] = G.ALPHAS) -> tuple[DataFrame, DataFrame]:
    """Per participant (participant, alpha, n, rmse, mae, r2, bias), held out from its model; and the summary over
    participants beside the metrics over all predictions. inner is a participant's part for tuning."""
    data = cut_lineage(G.complete_rows(rows, [participant, inner], target, features))
    centre = G.centre_of(data, len(features))
    own = by_participant(data, participant, inner, centre)
    models = tuned_models(own, participant, part_totals(own, len(features) + 2), centre, alphas)
    made = data.join(models, participant).select(participant, "alpha", F.col("_y").alias("actual"), G.predicted(F.col("_x"), F.col("weights")).alias("predicted"))
    each = made.groupBy(participant, "alpha").agg(F.count(F.lit(1)).alias("n"), *error_columns("actual", "predicted"))
    summary = each.agg(F.count(F.lit(1)).alias("participants"), *[f(m).alias(f"{n}_{m}") for n, f in (("mean", F.avg), ("std", F.stddev_pop)) for m in ("rmse", "mae", "r2")])
    pooled = made.agg(*[c.alias(f"global_{n}") for c, n in zip(error_columns("actual", "predicted"), ("rmse", "mae", "r2", "bias"))])
    return each, summary.crossJoin(F.broadcast(pooled))  # one row each


def personalised(data: DataFrame, models: DataFrame, participant: str, session: str, first: str, second: str, others: tuple[str, str] = ("others_mean", "others_n")) -> DataFrame:
    """(participant, method, n_s1, n_s2, scalar_correction, rmse, mae, r2, bias) on the second session of each
    participant with both. models has a row for each participant: weights, and mean and number of the training rows."""
    mean, number = others
    s, y = F.col(session).cast("string"), F.col("_y")
    rows = data.where(s.isin(first, second)).join(models, participant).withColumn("_one", s == first).withColumn("_p", G.predicted(F.col("_x"), F.col("weights")))
    one = F.col("_one")
    known = rows.groupBy(participant).agg(F.count_if(one).alias("n_s1"), F.count_if(~one).alias("n_s2"), F.avg(F.when(one, y - F.col("_p"))).alias("scalar_correction"), F.sum(F.when(one, y)).alias("_sum"))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(participant, "_one").orderBy("_order")) - 1)
    two = rows.where(~one).join(known.where("n_s1 > 0 AND n_s2 > 0"), participant).withColumn("_place", (F.col("_place") % F.col("n_s1")).cast("int"))
    two = two.join(rows.where(one).select(participant, "_place", y.alias("_repeated")), [participant, "_place"])
    guesses = {
        METHODS[0]: F.col("_p") + F.col("scalar_correction"), METHODS[1]: F.col(mean),
        METHODS[2]: (F.col(mean) * F.col(number) + F.col("_sum")) / (F.col(number) + F.col("n_s1")), METHODS[3]: F.col("_repeated"),
    }
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("method"), p.alias("predicted")) for m, p in guesses.items()]))
    made = two.select(participant, "n_s1", "n_s2", "scalar_correction", y.alias("actual"), each)
    correction = F.when(F.col("method") == METHODS[0], F.col("scalar_correction"))
    return made.groupBy(participant, "method", "n_s1", "n_s2", correction.alias("scalar_correction")).agg(*error_columns("actual", "predicted"))


def loso_personalised(rows: DataFrame, participant: str, session: str, inner: str, order: str, target: str, features: list[str], first: str, second: str, alphas: Iterable[float] = G.ALPHAS) -> DataFrame:
    """Personalisation of each participant by a ridge tuned and fitted on everyone else's two sessions. order numbers a
    participant's rows; the first session is repeated in it."""
    data = cut_lineage(_sessions(rows, participant, session, inner, order, target, features, first, second))
    centre = G.centre_of(data, len(features))
    own = by_participant(data, participant, inner, centre)
    totals = part_totals(own, len(features) + 2)
    n = sum(g[0, 0] for g in totals.values())
    mine = own.select(participant, F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["gram"][0]).alias("_own"))
    models = tuned_models(own, participant, totals, centre, alphas).join(mine, participant).withColumn("others_n", F.lit(float(n)) - F.col("_own"))
    return personalised(data, models, participant, session, first, second)


def locked_test(train: DataFrame, test: DataFrame, participant: str, session: str, inner: str, order: str, target: str, features: list[str], first: str, second: str, alphas: Iterable[float] = G.ALPHAS) -> DataFrame:
    """The same methods on a test table that no model was fitted on: one ridge, tuned over the inner parts of the training pool."""
    pool = _sessions(train, participant, session, inner, order, target, features, first, second)
    centre = G.centre_of(pool, len(features))
    parts = {r[inner]: G.square(r["gram"], len(features) + 2) for r in G.grams(pool, [inner], centre).collect()}  # a row for each part
    alphas = list(alphas)
    fits = [G.ridge(a) for a in alphas]
    total = sum(parts.values())
    w = G.uncentred(fits[G.tuned(parts, fits)](total), centre)
    held = _sessions(test, participant, session, inner, order, target, features, first, second)
    models = held.select(participant).distinct().select(
        participant, F.array(*[F.lit(float(v)) for v in w]).alias("weights"), F.lit(float(G.moments(total)[1][-1] + centre[-1])).alias("others_mean"), F.lit(float(total[0, 0])).alias("others_n"))
    return personalised(held, models, participant, session, first, second)


def _sessions(rows: DataFrame, participant: str, session: str, inner: str, order: str, target: str, features: list[str], first: str, second: str) -> DataFrame:
    """Complete rows of the two sessions, their labels stripped; a session elsewhere, or a missing participant, is left out."""
    named = rows.withColumn(session, F.trim(F.col(session).cast("string")))
    made = named.where(F.col(session).isin(first, second) & F.col(participant).isNotNull())
    return G.complete_rows(made, [participant, session, inner, F.col(order).alias("_order")], target, features)


def method_summary(each: DataFrame) -> DataFrame:
    """Mean and sample deviation of the participants' metrics per method, least mean RMSE first."""
    return each.groupBy("method").agg(F.count(F.lit(1)).alias("participants"), *[f(m).alias(f"{m}_{n}") for m in ("rmse", "mae", "r2", "bias") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]).orderBy("rmse_mean")


def loso_selection(rows: DataFrame, participant: str, inner: str, target: str, features: list[str], keep: int, how: str = "rfe") -> DataFrame:
    """(participant, chosen, n, mse, r2): the features chosen without a participant, and least squares on them, held out.

    'rfe' drops the least coefficient of scaled features again and again; 'sbs' drops the feature whose loss costs least
    over the inner parts. Both sweep features out of the participant's matrix; the rows are not read again.
    """
    if how not in ("rfe", "sbs"):
        raise ValueError("how is rfe or sbs")
    data = cut_lineage(G.complete_rows(rows, [participant, inner], target, features))
    centre, size = G.centre_of(data, len(features)), len(features) + 2
    own = by_participant(data, participant, inner, centre)

    def make(rest: dict[int, np.ndarray], mine: np.ndarray) -> Iterable[tuple]:
        total = sum(rest.values())
        left = G.recursive_elimination(total, keep) if how == "rfe" else G.backward_selection(rest, keep)
        model = G.Swept(total)
        for k in set(range(size - 2)) - set(left):
            model.drop(k)
        error, spread = G.squared_error(mine, model.weights()), G.moments(mine)[2][-1, -1]
        yield [features[k] for k in left], int(round(mine[0, 0])), error / mine[0, 0], 1 - error / spread if mine[0, 0] > 1.5 and spread > 0 else None

    return left_out(own, participant, part_totals(own, size), make, "chosen array<string>, n long, mse double, r2 double")


def selection_stability(selection: DataFrame, least: float = 0.5) -> DataFrame:
    """(feature, count, frequency, stable): in how many participants' selections a feature is, most frequent first."""
    n = selection.agg(F.count(F.lit(1)).alias("_n"))
    found = selection.select(F.explode("chosen").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("count"))
    made = found.crossJoin(F.broadcast(n)).select("feature", "count", (F.col("count") / F.col("_n")).alias("frequency"))
    return made.withColumn("stable", F.col("frequency") >= least).orderBy(F.desc("frequency"), "feature")
