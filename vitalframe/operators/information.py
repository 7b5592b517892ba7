"""Mutual information by nearest neighbours, without a task that holds a column.

Points of a group (a feature with the target, or a pair of features) are dealt to tiles of the plane, each cut across its
wider side, and a tile finds the k-th nearest point of its own points. Only points whose reach leaves the tile are sent on
to the other tiles that it touches. Counts within the reach are taken along either coordinate in strips: a strip counts
its own rows, strips that lie wholly within the reach add their sizes, and only ends that cut another strip are sent there.
So work grows with the points, ties or not, and results are those of a search over the whole group. Cuts come from a sample
of the points; they decide how work is spread, never a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from vitalframe.functions.nulls import clean_num
from vitalframe.kernels.information import Plane, _within, digamma, ends_within
from vitalframe.operators.ordering import _joined, _starts, range_id, sketched
from vitalframe.session import cut_lineage

#: Points of a tile, about; how many times that a strip holds; points of the sample for each tile; most points that are
#: sent on to a strip in one group.
BLOCK_ROWS, STRIP, SAMPLED, SENT = 1 << 15, 8, 64, 1 << 19
#: The steps that part ties.
STEPS = {"_x": 0.6180339887498949, "_y": 0.7548776662466927}


def complete_points(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, _x, _y) of all rows, NULL where a number is missing or not finite."""
    return rows.select(*keys, clean_num(F.col(x).cast("double")).alias("_x"), clean_num(F.col(y).cast("double")).alias("_y"))


def numbered_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _i, _x, _y) of all points, _i their place in the order of y, then x, counted over ranges of y, and of x where
    one y fills a range."""
    have = rows.where("_x IS NOT NULL AND _y IS NOT NULL")
    cut = _joined(have, sketched(have, ["_y"], keys), keys).withColumn("_by_y", range_id(F.col("_y"), F.col("_cuts0"))).drop("_cuts0", "_total0")
    own = [*keys, "_by_y"]
    inner = sketched(cut.where("_by_y % 2 = 1"), ["_x"], own).drop("_total0")
    cut = cut.join(inner, own, "left").withColumn("_by_x", F.when(F.col("_cuts0").isNotNull(), range_id(F.col("_x"), F.col("_cuts0"))).otherwise(0)).drop("_cuts0")
    cut = cut.withColumn("_id", F.struct("_by_y", "_by_x"))
    starts = _starts(cut.groupBy(*keys, "_id").agg(F.count(F.lit(1)).alias("_n")), keys)
    starts = starts.select(*keys, F.col("_id._by_y").alias("_by_y"), F.col("_id._by_x").alias("_by_x"), "_start")
    place = F.row_number().over(Window.partitionBy(*keys, "_by_y", "_by_x").orderBy("_y", "_x")) - 1
    return cut.drop("_id").join(starts, [*keys, "_by_y", "_by_x"]).select(*keys, (F.col("_start") + place).alias("_i"), "_x", "_y")


def _cut(v: np.ndarray) -> float | None:
    """A cut in the widest gap of the middle third, so that equal values but for their parting stay together; None if all
    values are equal."""
    v = np.sort(v)
    at = np.arange(len(v) // 3, max(len(v) - len(v) // 3, len(v) // 3 + 2))
    at = at[at < len(v)]
    if not len(v) or v[at[0]] == v[at[-1]]:
        at = np.arange(len(v))
    gap = np.diff(v[at])
    if not len(gap) or gap.max() <= 0:
        return None
    return float(v[at[int(gap.argmax()) + 1]])


def strip_cuts(v: np.ndarray, most: float) -> np.ndarray:
    """Cuts of a sample into strips of at most `most` members each."""
    cut = _cut(v) if len(v) > most else None
    return np.zeros(0) if cut is None else np.concatenate([strip_cuts(v[v < cut], most), [cut], strip_cuts(v[v >= cut], most)])


@dataclass
class Tiles:
    """A tree of cuts: of each node the axis, the cut, and both children; a leaf has its own number as left child."""

    axis: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, most: float) -> Tiles:
        """Tiles of at most `most` members of the sample."""
        nodes: list[list] = []

        def grow(v: np.ndarray) -> int:
            me, cut = len(nodes), None
            nodes.append([0, 0.0, me, me])
            if len(v) > most:
                axis = int(np.ptp(v[:, 1]) > np.ptp(v[:, 0]))
                cut = _cut(v[:, axis])
            if cut is not None:
                right = v[:, axis] >= cut
                nodes[me] = [axis, cut, grow(v[~right]), grow(v[right])]
            return me

        grow(points)
        axis, cut, below, above = zip(*nodes)
        return cls(np.array(axis), np.array(cut), np.array(below), np.array(above))

    def own(self, v: np.ndarray) -> np.ndarray:
        """The tile of each point."""
        node = np.zeros(len(v), int)
        while True:
            to = np.where(v[np.arange(len(v)), self.axis[node]] >= self.cut[node], self.above[node], self.below[node])
            if (to == node).all():
                return node
            node = to

    def touched(self, v: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, tile) of all tiles that may hold a member nearer than each point's reach."""
        p, node, done = np.arange(len(v)), np.zeros(len(v), int), []
        while len(p):
            leaf = self.below[node] == node
            done.append((p[leaf], node[leaf]))
            p, node = p[~leaf], node[~leaf]
            u, cut = v[p, self.axis[node]], self.cut[node]
            low, high = (u < cut) | (u - cut < reach[p]), (u >= cut) | (cut - u < reach[p])
            p, node = np.concatenate([p[low], p[high]]), np.concatenate([self.below[node[low]], self.above[node[high]]])
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def _lists(at: np.ndarray, values: np.ndarray, n: int) -> list:
    """Per row the values that carry its number; None for a row without."""
    out: list = [None] * n
    order = np.argsort(at, kind="stable")
    rows, first = np.unique(at[order], return_index=True)
    for r, part in zip(rows.tolist(), np.split(values[order], first[1:])):
        out[r] = part
    return out


def _tile_reaches(tiles: dict[int, Tiles], cuts: dict[str, dict[int, np.ndarray]], k: int):
    """Each point's strips; each point's k-th distance within its tile; if that leaves the tile, the k distances and the other tiles touched."""

    def work(b: pd.DataFrame) -> pd.DataFrame:
        g, v = int(b["_g"].iloc[0]), b[["_x", "_y"]].to_numpy()
        own = tiles[g]
        best = Plane(v[:, 0], v[:, 1]).nearest(k)
        p, tile = own.touched(v, best[:, k - 1])
        away = tile != b["_tile"].iloc[0]
        p, tile = p[away], tile[away]
        left = np.unique(p)
        strips = {f"_s{c}": np.searchsorted(cuts[c][g], b[c].to_numpy(), side="right") for c in STEPS}
        return b[["_g", "_i", "_x", "_y"]].assign(**strips, _reach=best[:, k - 1], _best=_lists(np.repeat(left, k), best[left].ravel(), len(b)), _others=_lists(p, tile, len(b)))

    return work


def _reaches(dealt: DataFrame, tiles: dict[int, Tiles], cuts: dict[str, dict[int, np.ndarray]], k: int) -> DataFrame:
    """(_g, _i, _x, _y, _s_x, _s_y, _reach) of all points."""
    names = ["_g", "_i", "_x", "_y", "_s_x", "_s_y", "_reach"]
    inside = cut_lineage(dealt.groupBy("_g", "_tile").applyInPandas(_tile_reaches(tiles, cuts, k), "_g int, _i long, _x double, _y double, _s_x int, _s_y int, _reach double, _best array<double>, _others array<int>"))
    done, left = inside.where("_others IS NULL").select(*names), inside.where("_others IS NOT NULL")
    if left.isEmpty():
        return done
    asked = left.select(F.col("_g").alias("_h"), F.explode("_others").alias("_to"), F.col("_i").alias("_j"), F.col("_x").alias("_u"), F.col("_y").alias("_v"), F.col("_best").alias("_known"))

    def look(base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if base.empty or asked.empty:
            return pd.DataFrame({"_g": [], "_i": [], "_near": []})
        known = np.repeat(np.vstack(asked["_known"].to_list())[:, k - 1 :], k, axis=1)
        near = Plane(base["_x"].to_numpy(), base["_y"].to_numpy()).nearer(asked["_u"].to_numpy(), asked["_v"].to_numpy(), known)
        near = np.where(near < known, near, np.inf)  # only what is found here
        return pd.DataFrame({"_g": asked["_h"], "_i": asked["_j"], "_near": list(near)})

    near = dealt.groupBy("_g", "_tile").cogroup(asked.groupBy("_h", "_to")).applyInPandas(look, "_g int, _i long, _near array<double>")
    near = near.groupBy("_g", "_i").agg(F.flatten(F.collect_list("_near")).alias("_near"))  # k for each tile touched
    met = left.join(near, ["_g", "_i"], "left").withColumn("_reach", F.sort_array(F.concat("_best", F.coalesce("_near", F.array().cast("array<double>"))))[k - 1])
    return cut_lineage(done.unionByName(met.select(*names)))


def _psi_sums(points: DataFrame, axis: str, cuts: dict[int, np.ndarray]) -> dict[int, float]:
    """Per group the sum over its points of digamma of how many points are within the point's reach along the axis."""
    strip = f"_s{axis}"
    strips: dict[int, np.ndarray] = {g: np.full((len(c) + 1, 3), np.nan) for g, c in cuts.items()}
    for r in points.groupBy("_g", strip).agg(F.min(axis).alias("low"), F.max(axis).alias("high"), F.count(F.lit(1)).alias("n")).collect():  # a row for each strip
        strips[r["_g"]][r[strip]] = r["low"], r["high"], r["n"]
    for g, c in cuts.items():  # an empty strip lies at its cut
        held, edge = strips[g], np.concatenate([c[:1], c]) if len(c) else np.zeros(1)
        empty = np.isnan(held[:, 2])
        held[empty] = np.stack([edge[empty], edge[empty], np.zeros(empty.sum())], 1)

    def count(b: pd.DataFrame) -> pd.DataFrame:
        g, s = int(b["_g"].iloc[0]), int(b[strip].iloc[0])
        low, high, n = strips[g].T
        v, reach, before = b[axis].to_numpy(), b["_reach"].to_numpy(), np.concatenate([[0.0], np.cumsum(n)])
        known = _within(np.sort(v), v, reach)
        (low_first, low_end), (high_first, high_end) = ends_within(low, v, reach), ends_within(high, v, reach)
        left, touched_left = np.minimum(low_first, s), np.minimum(high_first, s)
        right, touched_right = np.maximum(high_end, s + 1), np.maximum(low_end, s + 1)
        known = known + (before[s] - before[left] + before[right] - before[s + 1]).astype(int)
        at = np.concatenate([np.flatnonzero(touched_left < left), np.flatnonzero(touched_right > right)])
        to = np.concatenate([left[touched_left < left] - 1, right[touched_right > right]])
        on = np.unique(at)
        here = np.ones(len(b), bool)
        here[on] = False
        first = lambda head, tail: np.concatenate([[head], tail])  # noqa: E731  the strip's own sum, then what is sent on
        return pd.DataFrame({
            "_g": g, "_i": first(-1, b["_i"].to_numpy()[on]), "_v": first(0.0, v[on]), "_reach": first(0.0, reach[on]), "_known": first(0, known[on]),
            "_others": [None, *[x for x in _lists(at, to, len(b)) if x is not None]], "_psi": first(digamma(np.maximum(known[here], 1)).sum(), np.zeros(len(on)))})

    made = cut_lineage(points.groupBy("_g", strip).applyInPandas(count, "_g int, _i long, _v double, _reach double, _known long, _others array<int>, _psi double"))
    total = {r["_g"]: r["psi"] for r in made.groupBy("_g").agg(F.sum("_psi").alias("psi")).collect()}
    asked = made.where("_i >= 0").select("_g", F.explode("_others").alias("_to"), "_i", "_v", "_reach")
    sizes = {(r["_g"], r["_to"]): r["n"] for r in asked.groupBy("_g", "_to").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each strip
    if not sizes:
        return total
    parts = points.sparkSession.createDataFrame([(g, s, -(-n // SENT)) for (g, s), n in sizes.items()], f"_g int, {strip} int, _parts long")
    base = points.select("_g", strip, axis).join(F.broadcast(parts), ["_g", strip]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    asked = asked.join(F.broadcast(parts.withColumnRenamed(strip, "_to")), ["_g", "_to"]).select(F.col("_g").alias("_h"), "_to", F.pmod(F.xxhash64("_i"), "_parts").alias("_q"), "_i", "_v", "_reach")

    def look(base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_g": asked["_h"], "_i": asked["_i"], "_known": _within(np.sort(base[axis].to_numpy()), asked["_v"].to_numpy(), asked["_reach"].to_numpy())})

    more = base.groupBy("_g", strip, "_part").cogroup(asked.groupBy("_h", "_to", "_q")).applyInPandas(look, "_g int, _i long, _known long")
    counts = more.unionByName(made.where("_i >= 0").select("_g", "_i", "_known")).groupBy("_g", "_i").agg(F.sum("_known").alias("_known"))

    def psi(batches):
        for b in batches:
            yield pd.DataFrame({"_g": b["_g"], "_psi": digamma(np.maximum(b["_known"].to_numpy(), 1))})

    for r in counts.mapInPandas(psi, "_g int, _psi double").groupBy("_g").agg(F.sum("_psi").alias("psi")).collect():
        total[r["_g"]] += r["psi"]
    return total


def _dealt(points: DataFrame, keys: list[str], groups: dict[int, Row], block_rows: int) -> tuple[DataFrame, dict[int, Tiles], dict[str, dict[int, np.ndarray]]]:
    """(_g, _i, _x, _y, _tile) of the groups' standardised points with ties parted; their tiles, and the cuts of their strips."""
    names = points.sparkSession.createDataFrame([(g, *[r[c] for c in (*keys, "m_x", "m_y", "s_x", "s_y")]) for g, r in groups.items()], f"_g int, {_kinds(points, keys)}m_x double, m_y double, s_x double, s_y double")
    made = points.join(F.broadcast(names), keys)  # a row for each group
    square = F.col("_i").cast("double") * F.col("_i").cast("double")
    made = made.withColumns({c: (F.col(c) - F.col(f"m{c}")) / F.col(f"s{c}") + 1e-10 * ((square * step) % 1.0) for c, step in STEPS.items()}).select("_g", "_i", "_x", "_y")
    made = cut_lineage(made)
    share = min(1.0, SAMPLED / block_rows)
    drawn = made.where(F.pmod(F.xxhash64("_i"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("_g", "_x", "_y").toPandas()  # SAMPLED points for each tile
    tiles, cuts = {}, {c: {} for c in STEPS}
    for g in groups:
        v = drawn.loc[drawn["_g"] == g, ["_x", "_y"]].to_numpy()
        tiles[g] = Tiles.of(v, share * block_rows)
        for j, c in enumerate(STEPS):
            cuts[c][g] = strip_cuts(v[:, j], share * block_rows * STRIP)

    def deal(batches):
        for b in batches:
            tile = np.zeros(len(b), np.int32)
            for g, at in b.groupby("_g").indices.items():
                tile[at] = tiles[g].own(b[["_x", "_y"]].to_numpy()[at])
            yield b.assign(_tile=tile)

    return made.mapInPandas(deal, "_g int, _i long, _x double, _y double, _tile int"), tiles, cuts


def _kinds(rows: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys)


def psi_of(n: int) -> float:
    """Digamma of a count."""
    return float(digamma(np.array([n]))[0])


def neighbour_information(rows: DataFrame, keys: list[str], x: str, y: str, k: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, mi) in nats, at least 0: NULL below five points, 0 where a side is constant. keys name few groups."""
    read = cut_lineage(complete_points(rows, keys, x, y))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    stats = read.groupBy(*keys).agg(F.count_if(both).alias("_n"), *[f(F.when(both, F.col(c))).alias(f"{n}{c}") for c in STEPS for n, f in (("m", F.avg), ("s", F.stddev_pop))]).collect()
    groups = {g: r for g, r in enumerate(stats) if r["_n"] >= 5 and r["s_x"] > 0 and r["s_y"] > 0}
    found = {g: 0.0 if r["_n"] >= 5 else None for g, r in enumerate(stats)}
    if groups:
        dealt, tiles, cuts = _dealt(numbered_points(read, keys), keys, groups, block_rows)
        dealt = cut_lineage(dealt)
        near = _reaches(dealt, tiles, cuts, k)
        sums = [_psi_sums(near, c, cuts[c]) for c in STEPS]
        for g, r in groups.items():
            found[g] = max(0.0, psi_of(k) + psi_of(r["_n"]) - sum(s[g] for s in sums) / r["_n"])
    made = [(*[r[c] for c in keys], found[g]) for g, r in enumerate(stats)]
    return rows.sparkSession.createDataFrame(made, f"{_kinds(rows, keys)}mi double")
