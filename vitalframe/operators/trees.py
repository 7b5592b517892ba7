"""Regression trees, forests and boosting fitted on every row by histograms.

Rows with equal bins are alike to every tree that the bins' thresholds can make, so one pass adds up their weights and
targets by tree. A level is one aggregation of these sums to (tree, node, feature, bin), running sums over a feature's bins give the gain of each split, and the best one of each node is all
that reaches the driver. A row's node is an expression of the splits so far, so no row is moved or rewritten. All trees
of a forest grow together; boosting adds one tree after another to the prediction.

Rows with a missing target or feature are left out. A split sends values up to its threshold to the left; of equal gains
the feature named first, then the smaller threshold, is taken. Thresholds are all values of a feature with at most `bins`
of them, else its quantiles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.operators.gram import complete_rows
from vitalframe.operators.ordering import exact_quantiles
from vitalframe.session import cut_lineage

BINS = 64
#: A gain up to so much of a node's sum of squares is rounding.
ROUNDING = 1e-9


@dataclass
class Tree:
    """Splits by node, (feature, threshold), and the value and weight of every node; the root is 1, children of k are 2k and 2k + 1."""

    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    values: dict[int, tuple[float, float]] = field(default_factory=dict)

    def _walk(self, x: Column, leaf, node: int = 1) -> Column:
        if node not in self.splits:
            return leaf(node)
        f, t = self.splits[node]
        return F.when(x[f] <= t, self._walk(x, leaf, 2 * node)).otherwise(self._walk(x, leaf, 2 * node + 1))

    def node(self, x: Column) -> Column:
        return self._walk(x, F.lit)

    def predicted(self, x: Column) -> Column:
        return self._walk(x, lambda k: F.lit(self.values[k][0] if k in self.values else 0.0))


def thresholds(data: DataFrame, size: int, bins: int = BINS) -> list[list[float]]:
    """The rising thresholds of each feature of _x, at most bins each; one value alone has none."""
    distinct = data.agg(*[F.approx_count_distinct(F.col("_x")[i], 0.02) for i in range(size)]).first()
    few = [i for i in range(size) if (distinct[i] or 0) <= 1.1 * bins]
    found: list[list[float]] = [[] for _ in range(size)]
    long = data.select(F.posexplode("_x").alias("f", "v"))
    if few:
        held = long.where(F.col("f").isin(few)).distinct()
        rank = F.row_number().over(Window.partitionBy("f").orderBy("v"))
        for r in held.withColumn("r", rank).where(F.col("r") <= 2 * bins + 1).orderBy("f", "v").collect():  # bounded by features and bins
            found[r["f"]].append(r["v"])
    many = [i for i in range(size) if i not in few or len(found[i]) > bins + 1]
    if many:
        for i in many:
            found[i] = []
        for r in exact_quantiles(long.where(F.col("f").isin(many)), "v", [k / bins for k in range(1, bins)], ["f"]).orderBy("f", "quantile").collect():
            found[r["f"]].append(r["quantile"])
        most = {r["f"]: r["m"] for r in long.where(F.col("f").isin(many)).groupBy("f").agg(F.max("v").alias("m")).collect()}
        return [[*sorted(set(v) - {most[i]})] if i in many else v[:-1] for i, v in enumerate(found)]
    return [v[:-1] for v in found]


def _bin(x: Column, edges: list[float]) -> Column:
    """How many thresholds are below the value, by a balanced tree of comparisons."""
    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x <= edges[mid], below(low, mid)).otherwise(below(mid + 1, high))

    return below(0, len(edges))


def grow(data: DataFrame, edges: list[list[float]], targets: list[Column], weights: list[Column], depth: int, least: float = 1.0, allowed: list[list[int]] | None = None) -> list[Tree]:
    """One tree for each target and weight, all grown level by level over the same rows. allowed names each tree's features."""
    trees = [Tree() for _ in targets]
    allowed = allowed or [list(range(len(edges))) for _ in targets]
    bins = F.array(*[_bin(F.col("_x")[i], e) for i, e in enumerate(edges)])
    active = [{1} for _ in targets]
    w, y = ([c.cast("double") for c in columns] for columns in (weights, targets))
    sums = [F.sum(F.when(w[t] > 0, v)).alias(f"{n}{t}") for t in range(len(trees)) for n, v in (("w", w[t]), ("s", w[t] * y[t]), ("q", w[t] * y[t] * y[t]))]
    cells = cut_lineage(data.groupBy(bins.alias("bins")).agg(*sums))
    inside = F.array(*[F.get(F.array(*[F.lit(float(t)) for t in e], F.lit(float("inf"))), F.col("bins")[i]) for i, e in enumerate(edges)])  # a value of the cell's bins
    cells = cells.withColumn("_x", inside)
    for level in range(max(depth, 1)):
        each = [F.struct(F.lit(t).alias("tree"), trees[t].node(F.col("_x")).alias("node"), *[F.col(f"{c}{t}").alias(c) for c in "wsq"]) for t in range(len(trees)) if active[t]]
        if not each:
            break
        rows = cells.select("bins", F.inline(F.array(*each))).where((F.col("node") >= 1 << level) & (F.col("w") > 0))
        spread = rows.select("tree", "node", *"wsq", F.posexplode("bins").alias("f", "b"))
        hist = spread.groupBy("tree", "node", "f", "b").agg(*[F.sum(c).alias(c) for c in "wsq"])
        upto, whole = Window.partitionBy("tree", "node", "f").orderBy("b"), Window.partitionBy("tree", "node", "f")
        hist = hist.select("tree", "node", "f", "b", *[F.sum(c).over(upto).alias(f"l{c}") for c in "ws"], *[F.sum(c).over(whole).alias(c) for c in "wsq"])
        gain = F.col("ls") * F.col("ls") / F.col("lw") + (F.col("s") - F.col("ls")) * (F.col("s") - F.col("ls")) / (F.col("w") - F.col("lw")) - F.col("s") * F.col("s") / F.col("w")
        named = F.lit(False)
        for t, own in enumerate(allowed):
            named = named | ((F.col("tree") == t) & F.col("f").isin(own))
        fits = named & (F.col("lw") >= least) & (F.col("w") - F.col("lw") >= least)
        best = hist.withColumn("gain", F.when(fits, gain)).groupBy("tree", "node").agg(
            F.max("w").alias("w"), F.max_by("s", F.struct(-F.col("f"), F.col("b"))).alias("s"), F.max("q").alias("q"),
            F.max_by(F.struct("f", "b", "lw", "ls", "gain"), F.when(F.col("gain").isNotNull(), F.struct("gain", -F.col("f"), -F.col("b")))).alias("split"))
        active = [set() for _ in trees]
        for r in best.collect():  # a row for each node
            tree, k, split = trees[r["tree"]], r["node"], r["split"]
            tree.values[k] = (r["s"] / r["w"], r["w"])
            if depth and split is not None and split["gain"] > ROUNDING * r["q"]:
                tree.splits[k] = (split["f"], edges[split["f"]][split["b"]])
                tree.values[2 * k] = (split["ls"] / split["lw"], split["lw"])
                tree.values[2 * k + 1] = ((r["s"] - split["ls"]) / (r["w"] - split["lw"]), r["w"] - split["lw"])
                active[r["tree"]].add(k)
    return trees


def fit_tree(rows: DataFrame, target: str, features: list[str], depth: int, least: float = 1.0, bins: int = BINS) -> Tree:
    data = complete_rows(rows, [], target, features)
    return grow(data, thresholds(data, len(features), bins), [F.col("_y")], [F.lit(1.0)], depth, least)[0]


def tree_table(spark, tree: Tree, features: list[str]) -> DataFrame:
    """(node, feature, threshold, n, value), a row for each node; a leaf has no feature and threshold."""
    made = [(k, features[tree.splits[k][0]] if k in tree.splits else None, tree.splits[k][1] if k in tree.splits else None, n, v) for k, (v, n) in sorted(tree.values.items())]
    return spark.createDataFrame(made, "node int, feature string, threshold double, n double, value double")


@dataclass
class Ensemble:
    """A constant and trees, whose values are added with one factor."""

    features: list[str]
    start: float
    factor: float
    trees: list[Tree]

    def predicted(self, x: Column, upto: int | None = None) -> Column:
        total = F.lit(0.0)
        for t in self.trees[:upto]:
            total = total + t.predicted(x)
        return F.lit(self.start) + self.factor * total

    def predict(self, rows: DataFrame, out: str = "predicted") -> DataFrame:
        return rows.withColumn(out, self.predicted(F.array(*[F.col(f).cast("double") for f in self.features])))


def fit_boosted(rows: DataFrame, target: str, features: list[str], rounds: int, depth: int = 2, rate: float = 0.1, least: float = 1.0, bins: int = BINS) -> Ensemble:
    """Least squares boosting: each tree fits what the ones before leave."""
    data = complete_rows(rows, [], target, features)
    edges, mean = thresholds(data, len(features), bins), data.agg(F.avg("_y")).first()[0] or 0.0
    model = Ensemble(features, mean, rate, [])
    for _ in range(rounds):
        model.trees += grow(data, edges, [F.col("_y") - model.predicted(F.col("_x"))], [F.lit(1.0)], depth, least)
    return model


def fit_forest(rows: DataFrame, key: str, target: str, features: list[str], trees: int, depth: int = 4, least: float = 1.0, share: float = 1.0, bins: int = BINS, seed: int = 42) -> Ensemble:
    """Trees on resampled rows, all grown in the same aggregations. A row counts in a tree as often as a Poisson draw of
    mean one from a hash of its key says; each tree sees a share of the features, chosen by hash."""
    import xxhash

    data = complete_rows(rows, [F.col(key).alias("_key")], target, features)
    draw = lambda t: (F.pmod(F.xxhash64("_key", F.lit(seed), F.lit(t)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weights = []
    for t in range(trees):
        u, count, mass, term = draw(t), F.lit(0), 0.0, 0.36787944117144233
        for k in range(8):
            mass += term
            count = count + (u > mass).cast("int")
            term /= k + 1
        weights.append(count)
    some = max(1, round(share * len(features)))
    allowed = [sorted(range(len(features)), key=lambda f: xxhash.xxh64_intdigest(f"{seed}:{t}:{f}"))[:some] for t in range(trees)]
    return Ensemble(features, 0.0, 1.0 / trees, grow(data, thresholds(data, len(features), bins), [F.col("_y")] * trees, weights, depth, least, allowed))
