"""Personalised Gaussian process regression over whole tables.

A stationary kernel is the mean of products of cosines at random frequencies drawn from its spectrum. With a fixed
number of them the posterior mean is a ridge in those features, so it follows from an additive Gram matrix
(operators.gram) and no row ever meets another one. Kernel, length scale and noise are tuned over held-out parts, for all
candidates in one scan. Leaving out a participant's second session takes that session's own matrix off the total; adding
an unseen person's first session is an update by the matrix of its rows.

The features approximate the kernel: the error falls with the root of their number. Tuning takes the settings of a grid
in place of a gradient search, and for leave-one-out runs it is done once, over the parts of all participants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.operators import gram as G
from vitalframe.operators.loso import _sessions, error_columns
from vitalframe.session import cut_lineage

METHOD = "gp_personalization"
#: Smoothness of the kernels: infinite for the squared exponential, else Matern's.
KERNELS = (np.inf, 1.5, 2.5)
LENGTHS, NOISES = (0.5, 1.0, 2.0, 4.0), (0.01, 0.1, 1.0, 10.0)
COUNT = 64
#: Persons whose equations are solved at once.
SOLVED = 256


def spectrum(smoothness: float, size: int, count: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies of a kernel of length scale 1 in `size` dimensions, and phases."""
    rng = np.random.default_rng(seed)
    w, phase = rng.normal(size=(count, size)), rng.uniform(0, 2 * np.pi, count)
    if np.isfinite(smoothness):  # the spectrum of a Matern kernel is a multivariate t of twice its smoothness
        w /= np.sqrt(rng.chisquare(2 * smoothness, count) / (2 * smoothness))[:, None]
    return w, phase


def feature_map(smoothness: float, length: float, mean: np.ndarray, scale: np.ndarray, count: int = COUNT, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """Random Fourier features of standardised rows."""
    w, phase = spectrum(smoothness, len(mean), count, seed)

    def made(x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / count) * np.cos((x - mean) / scale @ (w / length).T + phase)

    return made


def posterior(noise: float) -> G.Fit:
    """Intercept (the mean of the target) and weights of the features, for a prior of variance 1 and this noise."""

    def fit(g: np.ndarray) -> np.ndarray:
        mean = g[0, -1] / g[0, 0]
        w = np.linalg.solve(g[1:-1, 1:-1] + noise * np.eye(len(g) - 2), g[1:-1, -1] - mean * g[0, 1:-1])
        return np.concatenate([[mean], w])

    return fit


class Process:
    """A tuned process: its feature map, noise, centre of the target, and the total matrix of the pool."""

    def __init__(self, pool: DataFrame, inner: str, size: int, count: int = COUNT, kernels=KERNELS, lengths=LENGTHS, noises=NOISES):
        centre = G.centre_of(pool, size)
        raw = G.grams(pool.withColumn("_k", F.lit(0)), ["_k"], centre).first()
        if raw is None:
            raise ValueError("no complete row to fit on")
        _, mean, scale, _, _ = G.standardised(G.square(raw["gram"], size + 2))
        settings = list(product(kernels, lengths))
        maps = [feature_map(s, length, mean[:-1] + centre[:-1], scale, count) for s, length in settings]
        self.centre = np.concatenate([np.zeros(count), centre[-1:]])
        parts: dict[int, dict] = {}
        for r in G.grams(pool, [inner], self.centre, maps).collect():  # settings * parts rows
            parts.setdefault(r["_map"], {})[r[inner]] = G.square(r["gram"], count + 2)
        best = min(((self._error(parts[k], noise), k, noise) for k in range(len(maps)) for noise in noises), key=lambda e: e[0])
        _, k, self.noise = best
        self.setting, self.map, self.total, self.size = settings[k], maps[k], sum(parts[k].values()), count + 2

    @staticmethod
    def _error(parts: dict[int, np.ndarray], noise: float) -> float:
        total, fit = sum(parts.values()), posterior(noise)
        held = [g for g in parts.values() if 0 < g[0, 0] < total[0, 0]] or [total]
        return float(np.mean([np.sqrt(G.squared_error(g, fit(total - g if g is not total else g)) / g[0, 0]) for g in held]))

    def all_weights(self, g: np.ndarray) -> np.ndarray:
        """Intercept and weights, for rows that the centre was not taken off, of a stack of matrices."""
        mean = g[:, 0, -1] / g[:, 0, 0]
        a, b = g[:, 1:-1, 1:-1] + self.noise * np.eye(self.size - 2), g[:, 1:-1, -1] - mean[:, None] * g[:, 0, 1:-1]
        return np.column_stack([mean + self.centre[-1], np.linalg.solve(a, b[..., None])[..., 0]])


def _by_person(process: Process, rows: DataFrame, participant: str, session: str, second: str, piece: int) -> DataFrame:
    """(participant, n_s1, n_s2, weights) of those with both sessions. The matrix of the piece of a person's rows is taken off
    the total if it is the second session (1) and added to it if it is the first (0).

    Rows meet sorted by person and are read as a stream: a task holds the matrix of the person at hand and those of some
    persons to solve, however many rows and persons there are.
    """
    named = rows.select(participant, (F.col(session) == second).cast("int").alias("_two"), "_x", "_y")
    kind, names = rows.schema[participant].dataType.simpleString(), [participant, "n_s1", "n_s2", "weights"]
    sign = -1.0 if piece else 1.0

    def solved(known: list[tuple]) -> pd.DataFrame:
        weights = process.all_weights(process.total + sign * np.stack([g for *_, g in known]))
        return pd.DataFrame([(*k[:3], w) for k, w in zip(known, weights.tolist())], columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, counts, gram, known = None, [0, 0], None, []
        for b in batches:
            if b.empty:
                continue
            z = np.column_stack([np.ones(len(b)), process.map(np.vstack(b["_x"].to_list())), b["_y"] - process.centre[-1]])
            keys, two = b[participant].to_numpy(), b["_two"].to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]) | (two[1:] != two[:-1])) + 1
            for low, high in zip([0, *edges], [*edges, len(b)]):
                if gram is None or keys[low] != who:
                    if all(counts):
                        known.append((who, *counts, gram))
                    who, counts, gram = keys[low], [0, 0], np.zeros((process.size, process.size))
                    if len(known) >= SOLVED:
                        yield solved(known)
                        known = []
                counts[two[low]] += int(high - low)
                if two[low] == piece:
                    gram += z[low:high].T @ z[low:high]
        if all(counts):
            known.append((who, *counts, gram))
        if known:
            yield solved(known)

    met = named.repartition(participant).sortWithinPartitions(participant, "_two")
    return met.mapInPandas(run, f"`{participant}` {kind}, n_s1 long, n_s2 long, weights array<double>")


def _judged(process: Process, rows: DataFrame, models: DataFrame, participant: str, session: str, second: str) -> DataFrame:
    """The errors on second sessions. Rows meet their person's weights as they are, and are mapped after that."""
    met = rows.where(F.col(session) == second).select(participant, "_x", "_y").join(models, participant)
    kind = rows.schema[participant].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low in range(0, len(b), 2048):
                part = b.iloc[low : low + 2048]
                w = np.vstack(part["weights"].to_list())
                made = w[:, 0] + np.einsum("rk,rk->r", process.map(np.vstack(part["_x"].to_list())), w[:, 1:])
                yield part[[participant, "n_s1", "n_s2"]].assign(actual=part["_y"], predicted=made)

    made = met.mapInPandas(run, f"`{participant}` {kind}, n_s1 long, n_s2 long, actual double, predicted double")
    each = made.groupBy(participant, "n_s1", "n_s2").agg(*error_columns("actual", "predicted"))
    return each.select(participant, F.lit(METHOD).alias("method"), "n_s1", "n_s2", F.lit(None).cast("double").alias("scalar_correction"), "rmse", "mae", "r2", "bias")


def loso_process(rows: DataFrame, participant: str, session: str, inner: str, order: str, target: str, features: list[str], first: str, second: str, **grid) -> DataFrame:
    """The process's metrics on each participant's second session, given everyone else's rows and the first session."""
    data = cut_lineage(_sessions(rows, participant, session, inner, order, target, features, first, second))
    process = Process(data, inner, len(features), **grid)
    models = _by_person(process, data, participant, session, second, 1)
    return _judged(process, data, models, participant, session, second)


def locked_process(train: DataFrame, test: DataFrame, participant: str, session: str, inner: str, order: str, target: str, features: list[str], first: str, second: str, **grid) -> DataFrame:
    """The same on a test table, given the training pool and the person's first session."""
    pool, held = (cut_lineage(_sessions(t, participant, session, inner, order, target, features, first, second)) for t in (train, test))
    process = Process(pool, inner, len(features), **grid)
    models = _by_person(process, held, participant, session, second, 0)
    return _judged(process, held, models, participant, session, second)
