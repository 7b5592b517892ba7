"""Whitening of embeddings by a compensated covariance.

Entries are put on a fixed grid, x = floor(64 c) + 1,000,000, so counts and sums are exact. Far from zero a plain
covariance loses what it measures; here every number is a pair of doubles, high and low part. The mean is divided out as
such a pair, rows are centred before they are multiplied, products and sums are split without error (two-sum, and
Dekker's two-product), and tasks merge their high and low parts by the same sums. Each task sends one row for each row of
the matrix, so merging is spread over as many groups as there are dimensions; only the matrix reaches the driver, whose
size is that of the dimensions. LAPACK's solver for symmetric matrices, which reduces to tridiagonal form and divides and
conquers, gives the components.

Columns of whiten: vec_id, component, n, deviation, whitened, explained, identity_error.

Defined cases: rows whose vector is null or empty, holds a null or an entry that is not finite, or one whose x is beyond
40 bits, are dropped; so are vectors of another length than the most frequent one (of equals, the longest).
Repeated and null ids are whitened each. A component without variance, up to rounding, has whitened 0 and is left out of
identity_error; without any variance explained is 0 too. An empty table gives an empty result; any further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import checkpointed, pick, small_batches, tidy

#: The grid's scale and shift.
SCALE, SHIFT = 64.0, 1_000_000
#: Largest |x|; sums that leave a long are an error.
LARGEST = 1 << 40
MOST_COMPONENTS = 32
#: Bytes of products that a task holds at once, and Dekker's constant.
HELD_BYTES, SPLIT = 4 << 20, 134217729.0
#: An eigenvalue up to so much of the largest is rounding.
ROUNDING = 1e-13

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b as the nearest double and the exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a * b as the nearest double and the exact error."""
    p = a * b
    x, y = SPLIT * a, SPLIT * b
    ah, bh = x - (x - a), y - (y - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: Pair, b: Pair) -> Pair:
    """The sum of two pairs."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def multiply(a: Pair, b: Pair) -> Pair:
    p, e = two_product(a[0], b[0])
    return two_sum(p, e + (a[0] * b[1] + a[1] * b[0]))


def divide(a: Pair, n: float) -> Pair:
    q = a[0] / n
    p, e = two_product(q, np.full_like(q, n))
    return two_sum(q, ((a[0] - p) - e + a[1]) / n)


def total(pair: Pair) -> Pair:
    """The sum over the first axis, halving it again and again."""
    high, low = pair
    while len(high) > 1:
        half = len(high) // 2
        odd = high[2 * half :], low[2 * half :]
        high, low = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        if len(odd[0]):
            high, low = np.concatenate([high, odd[0]]), np.concatenate([low, odd[1]])
    return high[0], low[0]


def centred(x: np.ndarray, mean: Pair) -> Pair:
    """x less the mean, as pairs."""
    s, e = two_sum(x, -mean[0])
    return two_sum(s, e - mean[1])


def outer_sums(x: np.ndarray, mean: Pair) -> Pair:
    """The sum of the centred rows' outer products, upper triangle row by row."""
    i, j = np.triu_indices(x.shape[1])
    step = max(1, HELD_BYTES // (8 * len(i)))
    done = np.zeros(len(i)), np.zeros(len(i))
    for at in range(0, len(x), step):
        high, low = centred(x[at : at + step], mean)
        done = add(done, total(multiply((high[:, i], low[:, i]), (high[:, j], low[:, j]))))
    return done


def grid(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which vectors count, and x of those that do."""
    found: list[np.ndarray | None] = []
    values = vectors.flatten()
    flat = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(SCALE * flat) + SHIFT
    good = np.isfinite(x) & (np.abs(x) <= LARGEST)
    ends = np.cumsum(lengths)
    for a, b in zip((ends - lengths).tolist(), ends.tolist()):
        found.append(x[a:b].astype(np.int64) if b > a and good[a:b].all() else None)
    return np.array([f is not None for f in found], bool), found


def gridded(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x) of the vectors that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, found = grid(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.array([f for f in found if f is not None], pa.list_(pa.int64()))], ["vec_id", "x"])

    rows = pick(rows, vec_id, vector).toDF("vec_id", "vector").withColumn("vector", F.col("vector").cast("array<double>"))
    return small_batches(rows).mapInArrow(tidy(run), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x array<long>")


def exact_sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """n and the sum of each dimension, over the vectors of the most frequent length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for b in batches:
            for x in b.column(0).to_pylist():
                own = seen.setdefault(len(x), [0, np.zeros(len(x), np.int64)])
                own[0] += 1
                own[1] += np.array(x, np.int64)
        out = [(size, at, n, s) for size, (n, sums) in seen.items() for at, s in enumerate(sums.tolist())]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["size", "at", "n", "s"]).astype({"size": "int32", "at": "int32", "n": "int64", "s": "int64"}), preserve_index=False)

    each = small_batches(rows.select("x")).mapInArrow(tidy(run), "size int, at int, n long, s long").groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    most = each.where("at = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return 0, np.zeros(0, np.int64)
    sums = each.where(F.col("size") == most["size"]).orderBy("at").select("s").toPandas()["s"]
    return most["n"], sums.to_numpy(np.int64)


def covariance(rows: DataFrame, column: str, n: int, mean: Pair) -> Pair:
    """The covariance matrix of an array column with this mean, divisor n, as high and low parts."""
    size = len(mean[0])
    kind = "at int, high array<double>, low array<double>"
    begins = np.cumsum([0, *range(size, 0, -1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(float)
                part = outer_sums(x, mean)
                done = part if done is None else add(done, part)
        if done is not None:
            parts = [[h[begins[i] : begins[i + 1]] for i in range(size)] for h in done]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *[pa.array(p, pa.list_(pa.float64())) for p in parts]], ["at", "high", "low"])

    def merge(some: pd.DataFrame) -> pd.DataFrame:
        high, low = total((np.stack(some["high"].to_list()), np.stack(some["low"].to_list())))
        return pd.DataFrame({"at": [some["at"].iloc[0]], "high": [high.tolist()], "low": [low.tolist()]})

    merged = small_batches(rows.select(column)).mapInArrow(tidy(run), kind).groupBy("at").applyInPandas(merge, kind)
    high, low = np.zeros((size, size)), np.zeros((size, size))
    for r in merged.collect():  # as many rows as dimensions
        high[r["at"], r["at"] :] = high[r["at"] :, r["at"]] = r["high"]
        low[r["at"], r["at"] :] = low[r["at"] :, r["at"]] = r["low"]
    return divide((high, low), float(n))


def mean_of(sums: np.ndarray, n: int) -> Pair:
    """The mean as pairs, from whole sums."""
    whole, rest = np.divmod(sums, n)
    return two_sum(whole.astype(float), rest / n)


def components(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors as columns, at most so many."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], vectors[:, order]


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = MOST_COMPONENTS) -> DataFrame:
    """A row for each vector that counts and each of the leading components."""
    placed = checkpointed(gridded(rows, vec_id, vector))
    n, sums = exact_sums(placed)
    kind = placed.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not n:
        return placed.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    fit = placed.where(F.size("x") == len(sums))
    mean = mean_of(sums, n)
    matrix, _ = covariance(fit, "x", n, mean)
    values, vectors = components(matrix, most)
    real = values > ROUNDING * values[0]
    trace = float(np.trace(matrix))
    explained = (np.where(real, values, 0.0) / trace if trace > 0 else np.zeros(len(values))).tolist()
    scaled = vectors * np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums))
            if len(x) and (float(np.abs(x - mean[0]).max()) * n + n) ** 2 * len(sums) < 2.0**62:
                deviation = ((x * n - sums) ** 2).sum(1).tolist()
            else:
                deviation = [sum(v * v for v in (n * int(a) - int(s) for a, s in zip(row, sums))) for row in x]
            high, low = centred(x.astype(float), mean)
            flat = (high @ scaled + low @ scaled).ravel()
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(explained), dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), values], ["vec_id", "deviation", "white"])

    made = checkpointed(small_batches(fit).mapInArrow(tidy(run), f"vec_id {kind}, deviation long, white array<double>"))
    error = identity_error(made, n, real)
    part = F.array(*[F.lit(e) for e in explained])
    each = made.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    shown = each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(part, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
    return shown.select(names)


def identity_error(made: DataFrame, n: int, real: np.ndarray) -> float:
    """The largest absolute entry of the whitened columns' covariance minus the identity, over components with variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = np.zeros(len(real)), np.zeros(len(real))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(real))
                done = add(done, total((x, np.zeros_like(x))))
        yield pa.RecordBatch.from_arrays([pa.array([done[0].tolist()], pa.list_(pa.float64())), pa.array([done[1].tolist()], pa.list_(pa.float64()))], ["high", "low"])

    parts = small_batches(made.select("white")).mapInArrow(tidy(run), "high array<double>, low array<double>")
    sums = parts.select(F.posexplode(F.arrays_zip("high", "low")).alias("at", "p")).groupBy("at").agg(F.sum("p.high").alias("high"), F.sum("p.low").alias("low")).orderBy("at").toPandas()
    mean = divide(two_sum(sums["high"].to_numpy(float), sums["low"].to_numpy(float)), float(n))
    matrix = covariance(made, "white", n, mean)[0][np.ix_(real, real)]
    return float(np.abs(matrix - np.eye(len(matrix))).max()) if len(matrix) else 0.0
