"""Ranks, running sums and quantiles over whole tables, without a window that holds a whole table in one task.

Values are cut into ranges at approximate quantiles. Totals of the ranges are prefix-summed, one row per range, and only
the rows within a range are sorted together. The cuts decide how work is spread, never a result. A number that fills
several ranges is a range of its own, which needs no order.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from vitalframe.functions.nulls import col_of
from vitalframe.session import cut_lineage

#: Rows of a range, about, and the fewest and most ranges that a table is cut into.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1 << 18, 16, 4096
#: Cuts of each group's sketch (one less than a power of two), and its accuracy.
CUTS, ACCURACY = 255, 10_000


def place_on_line(rows: DataFrame, value: str) -> Column:
    """A double that never falls as the value rises; of a text, its first six bytes."""
    kind, c = rows.schema[value].dataType, F.col(value)
    if isinstance(kind, StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def range_of(rows: DataFrame, value: str) -> Column:
    """The number of a row's range: how many cuts its value reaches. Ranges follow the rows; the cuts reach the driver."""
    place = place_on_line(rows, value)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(place, [k / MOST_RANGES for k in range(1, MOST_RANGES)], 10 * MOST_RANGES).alias("q")).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, 1 << (found["n"] // RANGE_ROWS).bit_length()))
    cuts = sorted(set((found["q"] or [])[MOST_RANGES // ranges - 1 :: MOST_RANGES // ranges]))

    def reached(low: int, high: int) -> Column:
        """The number of cuts up to the place, which is known to lie from low to high: comparisons as a balanced tree."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(place < cuts[mid], reached(low, mid)).otherwise(reached(mid + 1, high))

    return reached(0, len(cuts))


def each_number(rows: DataFrame, first: Column, last: Column, out: str, chunk: int = 1 << 16) -> DataFrame:
    """A row for each whole number from first to last; a long stretch is cut into chunks, so no row holds all of it."""
    some = rows.withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long")).where("_first <= _last")
    cut = some.withColumn("_from", F.explode(F.sequence("_first", "_last", F.lit(chunk).cast("long"))))
    return cut.withColumn(out, F.explode(F.sequence("_from", F.least(F.col("_from") + (chunk - 1), F.col("_last"))))).drop("_first", "_last", "_from")


def running(rows: DataFrame, order: str, weight, out: str, keys: list[str] = [], bucket: Column | None = None) -> DataFrame:  # noqa: B006
    """rows with the sum of the weights up to and with each row in the order of `order`, per keys; values of `order` are distinct within keys."""
    cut = rows.withColumn("_range", range_of(rows, order) if bucket is None else bucket).withColumn("_weight", col_of(weight))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "_range").agg(F.sum("_weight").alias("_sum")).select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_inside", F.sum("_weight").over(inside)).join(starts, [*keys, "_range"]).withColumn(out, F.col("_start") + F.col("_inside")).drop("_range", "_weight", "_inside", "_start")


def with_neighbour(rows: DataFrame, value: str, out: str, ahead: bool = False) -> DataFrame:
    """Each distinct value with the next smaller one, or with the next larger one; NULL at the end."""
    cut = rows.withColumn("_range", range_of(rows, value))
    edge, step = (F.min, F.lead) if ahead else (F.max, F.lag)
    edges = cut.groupBy("_range").agg(edge(value).alias("_edge")).select("_range", step("_edge").over(Window.orderBy("_range")).alias("_beside"))
    inside = step(value).over(Window.partitionBy("_range").orderBy(value))
    return cut.withColumn("_inside", inside).join(edges, "_range").withColumn(out, F.coalesce("_inside", "_beside")).drop("_range", "_inside", "_beside")


def sketched(rows: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """A row for each group: the number of values and their cuts, as _total<i> and _cuts<i>."""
    shares = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    return rows.groupBy(*keys).agg(*[x for i, v in enumerate(values) for x in (F.count(v).alias(f"_total{i}"), F.percentile_approx(F.col(v).cast("double"), shares, ACCURACY).alias(f"_cuts{i}"))])


def _joined(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(small, keys) if keys else rows.crossJoin(F.broadcast(small))  # one row without keys


def range_id(value: Column, cuts: Column) -> Column:
    """Twice the number of cuts up to the value; one less if the value is itself two of them, so that equal values that
    fill a range are a range of their own. Rises with the value."""
    steps = F.array(*[F.lit((CUTS + 1) >> k) for k in range(1, (CUTS + 1).bit_length())])
    reached = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) <= value, step).otherwise(0))
    alone = F.transform(F.array(reached), lambda r: r * 2 - F.when((F.get(cuts, r - 1) == value) & (F.get(cuts, r - 2) == value), 1).otherwise(0))
    return alone[0]


def _starts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts (keys, _id, _n) with the number of rows of the ranges before."""
    before = Window.partitionBy(*keys).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def average_ranks(rows: DataFrame, ranks: dict[str, str], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The rows that have all of the numbers named, with the average rank of each within keys, under the name given.

    Three reads of the rows: cuts of all columns, counts of all ranges, and one exchange for each column to sort its ranges.
    """
    values = list(ranks)
    have = rows.where(F.array_min(F.array(*[F.col(v).isNotNull() for v in values])))
    placed = _joined(have, sketched(have, values, keys), keys)
    placed = placed.withColumns({f"_id{i}": range_id(F.col(v).cast("double"), F.col(f"_cuts{i}")) for i, v in enumerate(values)}).drop(*[f"{c}{i}" for c in ("_cuts", "_total") for i in range(len(values))])
    each = placed.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_which"), F.col(f"_id{i}").alias("_id")) for i in range(len(values))])))
    starts = _starts(each.groupBy(*keys, "_which", "_id").agg(F.count(F.lit(1)).alias("_n")), [*keys, "_which"])
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(256))
    for i, v in enumerate(values):
        own = starts.where(F.col("_which") == i).select(*keys, F.col("_id").alias(f"_id{i}"), "_start", "_n")
        alone = F.col(f"_id{i}") % 2 == 1
        w = Window.partitionBy(*keys, f"_id{i}", "_salt").orderBy(v)
        met = placed.join(own, [*keys, f"_id{i}"]).withColumn("_salt", F.when(alone, spread).otherwise(F.lit(0)))
        inside = (F.rank().over(w) + F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2.0
        placed = met.withColumn("_inside", inside).withColumn(ranks[v], F.col("_start") + F.when(alone, (F.col("_n") + 1) / 2.0).otherwise(F.col("_inside"))).drop("_start", "_n", "_salt", "_inside")
    return placed.select(*rows.columns, *ranks.values())


def value_ranges(rows: DataFrame, value: str, out: str) -> tuple[DataFrame, list[float]]:
    """rows with the number of each double's range, and the numbers that are ranges of their own. Ranges are cut at
    approximate quantiles; a number that is two of them needs no order. NULL has no range."""
    place = F.col(value) + F.lit(0.0)  # a negative zero is a zero
    cuts = rows.agg(F.percentile_approx(place, [k / (CUTS + 1) for k in range(1, CUTS + 1)], ACCURACY).alias("q")).first()["q"] or []
    cuts = [c for c in cuts if math.isfinite(c)]
    heavy = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    splits = sorted({-math.inf, math.inf, *cuts, *[math.nextafter(h, math.inf) for h in heavy]})
    # Ranges that hold one number are odd.
    numbers = F.array(*[F.lit(2 * i + (a in heavy)) for i, a in enumerate(splits[:-1])])
    cut = Bucketizer(splits=splits, inputCol="_place", outputCol="_bucket", handleInvalid="keep").transform(rows.withColumn("_place", place))
    return cut.withColumn(out, F.when(F.col(value).isNotNull(), F.get(numbers, F.col("_bucket").cast("int")))).drop("_place", "_bucket"), heavy


def rank_correlations(rows: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(feature, n_unique, spearman): the number of distinct values of each feature, and the correlation of its average
    ranks with the target's over the rows that have both; NULL where either side is constant.

    The rows are sorted once, by ranges of the target. Each value of a feature then needs only how many rows it has and
    the sum of their targets' ranks, and the values are ranked by their running counts. Ranks are less their mean.
    """
    cut, heavy = value_ranges(rows.select(*[F.col(c).cast("double").alias(c) for c in (target, *features)]), target, "_id")
    long = cut.unpivot([target, "_id"], features, "feature", "value").where("value IS NOT NULL")
    by_feature = Window.partitionBy("feature")
    starts = _starts(long.where("_id IS NOT NULL").groupBy("feature", "_id").agg(F.count(F.lit(1)).alias("_n")), ["feature"]).withColumn("_middle", (F.sum("_n").over(by_feature) + 1) / 2.0)
    starts = cut_lineage(starts)  # some hundred rows for each feature, read often
    w = Window.partitionBy("feature", "_id").orderBy(target)
    inside = (F.rank().over(w) + F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2.0
    ranked = long.where("_id % 2 = 0").select("feature", "value", "_id", inside.alias("_inside"))
    if heavy or cut.where(F.col(target).isNull()).limit(1).count():
        ranked = ranked.unionByName(long.where("_id IS NULL OR _id % 2 = 1").select("feature", "value", "_id", F.lit(None).cast("double").alias("_inside")))
    at = F.col("_start") + F.coalesce("_inside", (F.col("_n") + 1) / 2.0) - F.col("_middle")
    met = ranked.join(F.broadcast(starts), ["feature", "_id"], "left").select("feature", "value", at.alias("_at"))
    values = cut_lineage(met.groupBy("feature", "value").agg(F.count("_at").alias("_n"), F.sum("_at").alias("_sum"), F.sum(F.col("_at") * F.col("_at")).alias("_squares")))
    placed = running(values, "value", "_n", "_upto", ["feature"]).join(F.broadcast(starts.groupBy("feature").agg(F.first("_middle").alias("_middle"))), "feature", "left")
    rank = F.col("_upto") - (F.col("_n") - 1) / 2.0 - F.col("_middle")
    made = placed.groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"), F.sum(rank * F.col("_sum")).alias("_xy"), F.sum(F.col("_n") * rank * rank).alias("_xx"), F.sum("_squares").alias("_yy"))
    return made.select("feature", "n_unique", F.try_divide("_xy", F.sqrt("_xx") * F.sqrt("_yy")).alias("spearman"))


def exact_quantiles(rows: DataFrame, value: str, shares: list[float], keys: list[str] = [], most: int = RANGE_ROWS) -> DataFrame:  # noqa: B006
    """(keys, share, quantile): exact quantiles of every group at once, between two values by linear interpolation; missing
    values are skipped.

    Each round cuts the ranges that hold a wanted place into finer ones and keeps only the rows of those that hold it,
    until none has more than `most` rows; these are then sorted. So no group is ever held in a buffer.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    path, places, done, turn = list(keys), None, None, 0
    while True:
        cuts = sketched(rows, ["_v"], path)
        if places is None:
            at = F.explode(F.transform(F.array(*[F.lit(float(s)) for s in shares]), lambda s: F.struct(s.alias("share"), ((F.col("_total0") - 1) * s).alias("at"))))
            both = cuts.where("_total0 > 0").select(*keys, at.alias("_p")).select(*keys, "_p.share", F.col("_p.at").alias("_at"))
            places = both.select(*keys, "share", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_place")).distinct().withColumn("_rest", F.col("_place"))
        placed = _joined(rows, cuts.drop("_total0"), path).withColumn("_id", range_id(F.col("_v"), F.col("_cuts0")))
        counts = _starts(placed.groupBy(*path, "_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least")), path)
        met = places.join(counts, path) if path else places.crossJoin(counts)  # a few places with a few hundred ranges
        met = cut_lineage(met.where((F.col("_start") <= F.col("_rest")) & (F.col("_rest") < F.col("_start") + F.col("_n"))).withColumn("_rest", F.col("_rest") - F.col("_start")))  # read often, and a few places of each group
        names = [*keys, "share", "_at", "_place"]
        known = met.where("_id % 2 = 1").select(*names, F.col("_least").alias("_found"))
        done = known if done is None else done.unionByName(known)
        left = met.where("_id % 2 = 0")
        largest = left.agg(F.max("_n")).first()[0] or 0
        step = f"_id_{turn}"
        places = left.select(*names, *[c for c in path if c not in keys], F.col("_id").alias(step), "_rest")
        rows = placed.withColumnRenamed("_id", step).drop("_cuts0").join(places.select(*path, step).distinct(), [*path, step], "left_semi")
        path, turn = [*path, step], turn + 1
        if largest <= most:
            break
    if not largest:
        return _between(done, keys)
    number = F.row_number().over(Window.partitionBy(*path).orderBy("_v")) - 1
    found = rows.withColumn("_rest", number.cast("long")).join(places.withColumn("_rest", F.col("_rest").cast("long")), [*path, "_rest"]).select(*names, F.col("_v").alias("_found"))
    return _between(done.unionByName(found), keys)


def _between(places: DataFrame, keys: list[str]) -> DataFrame:
    """The quantiles from the values found at the places on either side."""
    low = F.min(F.when(F.col("_place") == F.floor("_at"), F.col("_found")))
    high = F.max(F.when(F.col("_place") == F.ceil("_at"), F.col("_found")))
    every = places.groupBy(*keys, "share", "_at").agg(low.alias("_low"), high.alias("_high"))
    return every.select(*keys, "share", (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))).alias("quantile"))
