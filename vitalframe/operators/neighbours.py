"""Exact nearest neighbours without comparing all pairs.

Pivots are a bounded sample of the base rows. Every base row belongs to the cell of its nearest pivot, whose size and
radius are known. A query first looks into the nearest cells that hold enough rows; the k-th distance found there bounds
what is left to look for. By the triangle inequality a cell can only hold a nearer row if its pivot is no farther than
the bound and the cell's radius together, or the plane between its pivot and the query's is no farther than the bound.
All other cells are left out, so the result is exact whatever the pivots are; they decide the work.

Cells are gathered into bundles, and a query is sent once to each bundle with the cells that it looks into, so what is
sent does not grow with the number of cells. Bundles are cut into blocks of rows, and the queries that look into one into
blocks as well, so one large cell is many groups; each group keeps k rows per query, none beyond its bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most pivots, rows of a block, and what distances are widened by against rounding.
MOST_PIVOTS, BLOCK, SLACK = 256, 1 << 13, 1e-5
#: Distances that a task holds at once, and rows that it sends on at once.
HELD, SENT = 1 << 20, 1 << 12


def squares(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of v from all rows of w."""
    made = v @ w.T
    made *= -2
    made += (v**2).sum(1)[:, None]
    made += (w**2).sum(1)
    return made


def distances(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of v from all rows of w, to six digits."""
    return np.round(np.sqrt(np.maximum((v**2).sum(1)[:, None] - 2 * v @ w.T + (w**2).sum(1), 0)), 6)


@dataclass
class Layout:
    """Pivots, the distances between them, and size and radius of their cells."""

    pivots: np.ndarray
    between: np.ndarray
    size: np.ndarray
    radius: np.ndarray

    def first(self, far: np.ndarray, k: int) -> list[np.ndarray]:
        """The nearest cells of each query that hold k rows besides the query itself."""
        order = np.argsort(far, axis=1, kind="stable")
        held = np.cumsum(self.size[order], axis=1)
        return [o[: int(np.searchsorted(h, k + 1)) + 1] for o, h in zip(order, held)]

    def rest(self, far: np.ndarray, bound: np.ndarray, k: int) -> list[np.ndarray]:
        """The other cells that may hold a row within each query's bound."""
        own = far.argmin(1)
        near = far - self.radius[None] <= bound[:, None] + SLACK
        gap, apart = far**2 - far[np.arange(len(far)), own][:, None] ** 2, 2 * self.between[own]
        with np.errstate(invalid="ignore"):
            near &= (gap <= (bound[:, None] + SLACK) * apart + SLACK) | (apart == 0)
        near[np.arange(len(far)), own] = True
        near &= self.size[None] > 0
        return [np.setdiff1d(np.flatnonzero(row), seen) for row, seen in zip(near, self.first(far, k))]


class Cells:
    """A base table dealt to the cells of its pivots."""

    def __init__(self, base: DataFrame, most: int = MOST_PIVOTS, block: int = BLOCK):
        n = base.count()
        wanted = max(1, min(most, int(np.sqrt(n))))
        rows = base.select("_id", "_v").orderBy(F.xxhash64("_id"), "_id").limit(wanted).collect()
        self.pivots, self.block = np.array([r["_v"] for r in rows], float) if rows else np.zeros((0, 0)), block
        self.base = self._dealt(base)
        self.size, radius = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for r in self.base.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_far").alias("far")).collect():  # a row for each pivot
            self.size[r["_cell"]], radius[r["_cell"]] = r["n"], r["far"]
        self.bundle = self._bundles()
        self.layout = Layout(self.pivots, distances(self.pivots, self.pivots) if len(rows) else np.zeros((0, 0)), self.size, radius)

    def _bundles(self) -> np.ndarray:
        """The bundle of each cell: cells in the order of their distance from the first one, to a block of rows about."""
        order = np.argsort(distances(self.pivots, self.pivots[:1])[:, 0], kind="stable") if len(self.size) else np.zeros(0, int)
        held = np.cumsum(self.size[order])
        bundle = np.zeros(len(self.size), np.int32)
        bundle[order] = np.unique((held - self.size[order]) // self.block, return_inverse=True)[1]
        return bundle

    def _dealt(self, base: DataFrame) -> DataFrame:
        pivots = self.pivots

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                far = distances(np.vstack(b["_v"].to_list()), pivots) if len(b) else np.zeros((0, 1))
                cell = far.argmin(1)
                yield b.assign(_cell=cell.astype(np.int32), _far=far[np.arange(len(b)), cell])

        kinds = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in base.columns)
        return base.mapInPandas(run, f"{kinds}, _cell int, _far double")

    def looking(self, queries: DataFrame, pick: Callable[[pd.DataFrame, np.ndarray], list[np.ndarray]]) -> DataFrame:
        """(_id, _v, _bound, _bundle, _cells): each query once for each bundle that it looks into, with the cells there; NULL for all."""
        pivots, bundle = self.pivots, self.bundle
        whole = np.bincount(bundle[self.size > 0], minlength=bundle.max(initial=0) + 1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for large in batches:
                for at in range(0, len(large), SENT):
                    b = large.iloc[at : at + SENT]
                    cells = pick(b, distances(np.vstack(b["_v"].to_list()), pivots))
                    row, cell = np.repeat(np.arange(len(b)), [len(c) for c in cells]), np.concatenate([*cells, np.zeros(0, int)]).astype(np.int32)
                    order = np.lexsort((bundle[cell], row))
                    row, cell = row[order], cell[order]
                    first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(bundle[cell], prepend=-1))
                    parts = np.split(cell, first[1:]) if len(first) else []
                    to = bundle[cell[first]]
                    some = [c if len(c) < whole[t] else None for c, t in zip(parts, to)]
                    for part in range(0, len(first), SENT):
                        own = slice(part, part + SENT)
                        yield b[["_id", "_v", "_bound"]].iloc[row[first[own]]].assign(_bundle=to[own].astype(np.int32), _cells=pd.Series(some[own], dtype=object).to_numpy())

        kind = queries.schema["_id"].dataType.simpleString()
        return queries.mapInPandas(run, f"_id {kind}, _v array<double>, _bound double, _bundle int, _cells array<int>")

    def compared(self, looking: DataFrame, k: int) -> DataFrame:
        """(_id, _o, _d, _y): the k nearest rows of each query in each block of the cells that it looks into, itself apart."""
        asked = {r["_bundle"]: r["n"] for r in looking.groupBy("_bundle").agg(F.count(F.lit(1)).alias("n")).collect()}
        held = np.bincount(self.bundle, weights=self.size) if len(self.size) else np.zeros(0)
        blocks = lambda n: max(1, -(-int(n) // self.block))
        n_b, n_q = ([blocks(size.get(c, 0)) for c in range(len(held))] for size in (dict(enumerate(held)), asked))
        at = lambda counts: F.element_at(F.array(*[F.lit(c) for c in counts]), F.col("_bundle") + 1)
        dealt = lambda t, mine, theirs, a, b: t.withColumn(a, F.pmod(F.xxhash64("_id"), at(mine))).withColumn(b, F.explode(F.sequence(F.lit(0).cast("long"), at(theirs).cast("long") - 1)))
        q = dealt(looking, n_q, n_b, "_q", "_b").groupBy("_bundle", "_q", "_b")
        bundled = self.base.withColumn("_bundle", F.element_at(F.array(*[F.lit(int(c)) for c in self.bundle]), F.col("_cell") + 1))
        base = dealt(bundled.where(F.col("_bundle").isin(list(asked))) if len(asked) < len(held) else bundled, n_b, n_q, "_b", "_q").groupBy("_bundle", "_q", "_b")
        kind, other = looking.schema["_id"].dataType.simpleString(), self.base.schema["_id"].dataType.simpleString()

        def near(v: np.ndarray, me: np.ndarray, bound: np.ndarray, w: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(query, row, distance) of at most k rows of each query, by distance, then by key; rows of w are in their order."""
            out = []
            step = max(1, HELD // max(1, len(w)))
            for part in range(0, len(v), step):
                gap = squares(v[part : part + step], w)
                most = (bound[part : part + step] + SLACK) ** 2
                if not np.isfinite(most).all() and len(w) > k:
                    open_ = ~np.isfinite(most)
                    most[open_] = (np.sqrt(np.maximum(np.partition(gap[open_], k, axis=1)[:, k], 0)) + SLACK) ** 2  # one more, as it may be itself
                row, col = np.nonzero(gap <= most[:, None])
                d = np.round(np.sqrt(np.maximum(gap[row, col], 0)), 6)
                row += part
                keep = me[row] != ids[col]
                row, col, d = row[keep], col[keep], d[keep]
                order = np.lexsort((col, d, row))
                row, col, d = row[order], col[order], d[order]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                out.append([c[place < k] for c in (row, col, d)])
            return tuple(np.concatenate(c) for c in zip(*out))

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"_id": left["_id"][:0], "_o": right["_id"][:0], "_d": np.zeros(0), "_y": np.zeros(0)})
            right = right.sort_values("_id", kind="stable", ignore_index=True)
            v, me, bound = np.vstack(left["_v"].to_list()), left["_id"].to_numpy(), left["_bound"].to_numpy(float)
            w, ids, y, cell, out = np.vstack(right["_v"].to_list()), right["_id"].to_numpy(), right["_y"].to_numpy(float), right["_cell"].to_numpy(), []
            every = left["_cells"].isna().to_numpy()
            jobs = [(np.flatnonzero(every), np.arange(len(w)))] if every.any() else []
            some = np.flatnonzero(~every)
            if len(some):
                lists = [left["_cells"].iloc[i] for i in some]
                row, named = np.repeat(some, [len(c) for c in lists]), np.concatenate(lists)
                jobs += [(row[named == c], np.flatnonzero(cell == c)) for c in np.unique(named)]
            for asked, rows in jobs:
                if len(asked) and len(rows):
                    i, j, d = near(v[asked], me[asked], bound[asked], w[rows], ids[rows])
                    out.append(pd.DataFrame({"_id": me[asked[i]], "_o": ids[rows[j]], "_d": d, "_y": y[rows[j]]}))
            if not out:
                return pd.DataFrame({"_id": left["_id"][:0], "_o": right["_id"][:0], "_d": np.zeros(0), "_y": np.zeros(0)})
            made = pd.concat(out)
            if len(out) > 1:
                made = made.sort_values(["_id", "_d", "_o"], kind="stable")
                made = made[made.groupby("_id").cumcount() < k]
            return made

        return q.cogroup(base).applyInPandas(run, f"_id {kind}, _o {other}, _d double, _y double")


def _nearest(lists: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("_id").orderBy("_d", "_o"))
    return lists.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _plan(queries: DataFrame, base: DataFrame, key: str, vector: str, value: str, k: int, most: int, block: int):
    own = lambda t, *more: t.where(F.col(vector).isNotNull()).select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), *more)
    asked, cells = own(queries), Cells(own(base, F.col(value).cast("double").alias("_y")), most, block)
    layout = cells.layout
    first = cells.looking(asked.withColumn("_bound", F.lit(float("inf"))), lambda b, far: layout.first(far, k))
    found = _nearest(cells.compared(first, k), k)
    bound = found.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_bound"))
    bound = asked.join(bound, "_id", "left").withColumn("_bound", F.when(F.col("_n") >= k, F.col("_bound")).otherwise(float("inf")))
    rest = cells.looking(bound, lambda b, far: layout.rest(far, b["_bound"].to_numpy(float), k))
    return cells, first, found, rest


def nearest_neighbours(queries: DataFrame, base: DataFrame, key: str, vector: str, value: str, k: int, most: int = MOST_PIVOTS, block: int = BLOCK) -> DataFrame:
    """(key, predicted): the mean value of the k nearest base rows by Euclidean distance to six digits, ties by key, for
    each query vector; a row is not its own neighbour. Rows without a vector are left out."""
    if base.where(F.col(vector).isNotNull()).isEmpty():
        return queries.select(key, F.lit(None).cast("double").alias("predicted")).where("false")
    cells, _, found, rest = _plan(queries, base, key, vector, value, k, most, block)
    every = _nearest(found.unionByName(cells.compared(rest, k)), k)
    return every.groupBy("_id").agg(F.avg("_y").alias("predicted")).withColumnRenamed("_id", key)


def compared_pairs(queries: DataFrame, base: DataFrame, key: str, vector: str, value: str, k: int, most: int = MOST_PIVOTS, block: int = BLOCK) -> int:
    """How many pairs of a query and a base row the search compares."""
    cells, first, _, rest = _plan(queries, base, key, vector, value, k, most, block)
    looks = first.unionByName(rest).groupBy("_bundle", "_cells").agg(F.count(F.lit(1)).alias("n")).collect()
    held = np.bincount(cells.bundle, weights=cells.size)
    return int(sum(r["n"] * (held[r["_bundle"]] if r["_cells"] is None else sum(cells.size[c] for c in r["_cells"])) for r in looks))
