"""Joins and reshapes of study tables: metadata, fusion of modalities, as-of matches, table differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.functions.nulls import row_mean
from vitalframe.operators.ordering import each_number, running, with_neighbour


def with_metadata(rows: DataFrame, info: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join to the dataset index, pruned to the needed columns and to one row per key.

    Whether the index is broadcast is left to its measured size (spark.sql.autoBroadcastJoinThreshold).
    """
    return rows.join(info.select(key, *columns).dropDuplicates([key]), key, "left")


def unmatched(rows: DataFrame, info: DataFrame, key: str) -> DataFrame:
    """Rows without an entry in the index."""
    return rows.join(info.select(key).distinct(), key, "left_anti")


def fuse(tables: dict[str, DataFrame], keys: list[str], order: str) -> DataFrame:
    """Positional fusion of modalities within a key: shorter lists repeat cyclically up to the longest.

    Columns of each table other than the keys are prefixed with its modality. Keys that lack a modality drop out.
    Rows meet by (key, position modulo the list's length), so a key's product is never formed.
    """
    own = Window.partitionBy(*keys).orderBy(order)
    sized, counts = {}, []
    for name, t in tables.items():
        rest = [c for c in t.columns if c not in keys]
        sized[name] = t.withColumn("_i", (F.row_number().over(own) - 1).cast("long")).select(*keys, "_i", *[F.col(c).alias(f"{name}_{c}") for c in rest])
        counts.append(t.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n_{name}")))
    total = reduce(lambda a, b: a.join(b, keys), counts)
    n = [F.col(f"_n_{name}") for name in tables]
    spine = total.withColumn("repetition", F.explode(F.sequence(F.lit(0).cast("long"), (F.greatest(*n) if len(n) > 1 else n[0]) - 1)))
    for name, t in sized.items():
        spine = spine.withColumn("_i", F.pmod("repetition", f"_n_{name}")).join(t, [*keys, "_i"]).drop("_i")
    return spine.drop(*[f"_n_{name}" for name in tables])


def fused_quality(fused: DataFrame, suffix: str = "quality_indicator") -> DataFrame:
    """quality_indicator: the mean of the modalities' own, missing ones skipped."""
    return fused.withColumn(suffix, row_mean(*[c for c in fused.columns if c.endswith(suffix)]))


def last_before_first_after(peaks: DataFrame, onsets: DataFrame, key: str, at: str) -> DataFrame:
    """For each peak the last onset before it and the first after it; peaks that lack either drop out.

    One sort of the union of both, instead of a range join.
    """
    both = peaks.select(key, at, F.lit(1).alias("_peak")).unionByName(onsets.select(key, at, F.lit(0).alias("_peak")))
    onset = F.when(F.col("_peak") == 0, F.col(at))
    back = Window.partitionBy(key).orderBy(F.col(at), F.col("_peak").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(key).orderBy(F.col(at), F.col("_peak")).rowsBetween(1, Window.unboundedFollowing)
    found = both.select(key, at, "_peak", F.last(onset, ignorenulls=True).over(back).alias("onset"), F.first(onset, ignorenulls=True).over(ahead).alias("next_onset"))
    return found.where("_peak = 1 AND onset IS NOT NULL AND next_onset IS NOT NULL").select(key, "onset", F.col(at).alias("peak"), "next_onset")


def next_after(left: DataFrame, right: DataFrame, key: str, at: str) -> DataFrame:
    """For each left position the first right position strictly after it."""
    both = left.select(key, at, F.lit(1).alias("_left")).unionByName(right.select(key, at, F.lit(0).alias("_left")))
    ahead = Window.partitionBy(key).orderBy(F.col(at), F.col("_left")).rowsBetween(1, Window.unboundedFollowing)
    return both.withColumn("next_at", F.first(F.when(F.col("_left") == 0, F.col(at)), ignorenulls=True).over(ahead)).where("_left = 1").drop("_left")


def paired_by_position(a: DataFrame, b: DataFrame, key: str, at: str) -> DataFrame:
    """The n-th row of a with the n-th of b within a key, up to the shorter list."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(at))
    left = a.select(key, nth.alias("n"), F.col(at).alias("a"))
    return left.join(b.select(key, nth.alias("n"), F.col(at).alias("b")), [key, "n"])


def table_difference(a: DataFrame, b: DataFrame, key: str, columns: list[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Per column: compared rows, rows that differ, and the largest and mean absolute difference. Missing equals missing."""
    long = lambda t, name: t.unpivot([key], columns, "column", name)
    both = long(a, "x").join(long(b, "y"), [key, "column"], "full")
    gap = F.abs(F.col("x") - F.col("y"))
    same = (F.col("x").isNull() & F.col("y").isNull()) | F.coalesce(gap <= atol + rtol * F.abs("y"), F.lit(False))
    return both.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("n_different"), F.max(gap).alias("max_difference"), F.avg(gap).alias("mean_difference"))


def repeated_to(rows: DataFrame, targets: DataFrame, key: str, order_rows: str, order_targets: str, value: str) -> DataFrame:
    """The key's values, repeated cyclically over its targets."""
    own, other = Window.partitionBy(key).orderBy(order_rows), Window.partitionBy(key).orderBy(order_targets)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    base = rows.select(key, value, (F.row_number().over(own) - 1).alias("_i"), n.alias("_n"))
    counts = base.select(key, "_n").distinct()
    wanted = targets.withColumn("_t", F.row_number().over(other) - 1).join(counts, key).withColumn("_i", F.pmod("_t", "_n"))
    return wanted.join(base.drop("_n"), [key, "_i"]).drop("_i", "_t", "_n")


def merged_and_numbered(tables: list[tuple[str, DataFrame]], columns: list[str], order: str, exclude=None, prefix: str = "file_id") -> DataFrame:
    """UNION ALL of the datasets, numbered in order over all of them before rows are excluded, so that numbers may have holes."""
    parts = [t.select(*columns, F.lit(name).alias("dataset"), F.lit(i).alias("_dataset")) for i, (name, t) in enumerate(tables)]
    union = reduce(DataFrame.unionByName, parts)
    before = Window.orderBy("_dataset").rowsBetween(Window.unboundedPreceding, -1)
    starts = union.groupBy("_dataset").agg(F.count(F.lit(1)).alias("_n")).select("_dataset", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # Rows of one order value are numbered among themselves; values are counted before they are summed up.
    nth = F.row_number().over(Window.partitionBy("_dataset", order).orderBy(*[c for c in columns if c != order]))
    counts = running(union.groupBy("_dataset", order).agg(F.count(F.lit(1)).alias("_n")), order, "_n", "_upto", ["_dataset"])
    numbered = union.withColumn("_nth", nth).join(counts, ["_dataset", order]).withColumn("_own", F.col("_upto") - F.col("_n") + F.col("_nth"))
    numbered = numbered.drop("_nth", "_n", "_upto").join(F.broadcast(starts), "_dataset")  # one row per dataset
    made = numbered.withColumn("number", (F.col("_before") + F.col("_own")).cast("long")).withColumn(prefix, F.concat(F.lit(prefix), F.col("number").cast("string")))
    return (made if exclude is None else made.where(~exclude)).drop("_dataset", "_own", "_before")


def missing_numbers(rows: DataFrame, number: str, start: int) -> DataFrame:
    """Numbers from start to the largest that no row has, by gaps between neighbours instead of a full sequence."""
    have = rows.select(F.col(number).cast("long").alias("n")).distinct().where(F.col("n") >= start)
    have = have.unionByName(rows.sparkSession.range(1).select(F.lit(start - 1).cast("long").alias("n")))
    gaps = with_neighbour(have, "n", "next", ahead=True).where("next > n + 1")
    return each_number(gaps, F.col("n") + 1, F.col("next") - 1, "missing").select("missing")
