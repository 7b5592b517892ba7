"""Quality-gated segments, sliding windows and the selection of the best ones.

A sample table has file_id, i (0-based sample number) and q (quality). A segment is a half-open sample interval.
All operators are windows and aggregates on file_id, so their tasks grow with the longest file, not with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.functions.nulls import clean_num, meets
from vitalframe.operators.ordering import running


def threshold_runs(samples: DataFrame, threshold: float, fs: float = 1.0, min_seconds: float = 0.0, use_median: bool = True, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Maximal runs with q >= threshold of at least int(min_seconds * fs) samples; a NaN breaks a run.

    The run's number is the sample number less its rank among the good samples (gaps and islands), so one sort per file
    finds all runs and the aggregation reuses the partitioning.
    """
    good = samples.where(meets("q", threshold))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("i"))
    quality = F.median("q") if use_median else F.avg("q")
    runs = good.withColumn("_run", F.col("i") - rank).groupBy(*keys, "_run").agg(
        F.min("i").alias("start_sample"), F.count(F.lit(1)).alias("duration"), quality.alias("quality_indicator"))
    return runs.where(F.col("duration") >= max(1, int(min_seconds * fs))).drop("_run")


def whole_file_segment(samples: DataFrame, use_median: bool = True) -> DataFrame:
    """One segment per file that covers it."""
    quality = F.median(clean_num("q")) if use_median else F.avg(clean_num("q"))
    return samples.groupBy("file_id").agg(F.min("i").alias("start_sample"), F.count(F.lit(1)).alias("duration"), quality.alias("quality_indicator"))


def number_of_windows(n, size, shift) -> Column:
    """floor((n - size) / shift) + 1, and 0 for what is shorter than a window."""
    return F.when(n < size, F.lit(0)).otherwise(F.floor((n - size) / shift) + 1).cast("long")


def sliding_windows(segments: DataFrame, size: int, shift: int) -> DataFrame:
    """Windows of `size` samples every `shift` samples inside each segment; shorter segments give none."""
    n = number_of_windows(F.col("duration"), F.lit(size), F.lit(shift))
    fitting = segments.where(F.col("duration") >= size)
    return fitting.withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn(
        "start_sample", F.col("start_sample") + F.col("w") * shift).withColumn("duration", F.lit(size).cast("long"))


def samples_in(intervals: DataFrame, samples: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Every interval with the samples it holds. Intervals are exploded into sample numbers, so this is an equi-join on
    (file, sample) that shuffles both sides once and never compares all intervals of a file with all its samples."""
    wide = intervals.withColumn("i", F.explode(F.sequence("start_sample", F.col("start_sample") + F.col("duration") - 1)))
    return wide.join(samples, [*keys, "i"])


def window_quality(windows: DataFrame, samples: DataFrame, use_median: bool = True) -> DataFrame:
    """The quality of each window, recomputed from its own samples."""
    held = samples_in(windows.drop("quality_indicator"), samples)
    quality = F.median("q") if use_median else F.avg("q")
    return held.groupBy("file_id", "start_sample", "duration").agg(quality.alias("quality_indicator"))


def numbered(segments: DataFrame, *order) -> DataFrame:
    """segment_id seg_id<n>, numbered over all files in order.

    Counts per file are summed up over ranges of files, so no task holds all of them.
    """
    own = F.row_number().over(Window.partitionBy("file_id").orderBy("start_sample"))
    counts = segments.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n"))
    starts = running(counts, "file_id", "_n", "_upto").select("file_id", (F.col("_upto") - F.col("_n")).alias("_before"))
    return segments.withColumn("_own", own).join(starts, "file_id").withColumn(
        "segment_id", F.concat(F.lit("seg_id"), (F.col("_before") + F.col("_own") - 1).cast("string"))).drop("_own", "_before")


def best_per(segments: DataFrame, keys: tuple[str, ...] = ("file_id",), order: tuple = ("start_sample",)) -> DataFrame:
    """The segment of highest quality per key; NULL last, the first in order on ties."""
    w = Window.partitionBy(*keys).orderBy(F.col("quality_indicator").desc_nulls_last(), *[F.col(o) if isinstance(o, str) else o for o in order])
    return segments.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def complete_groups(rows: DataFrame, keys: tuple[str, ...], required: list[str], modality: str = "modality") -> DataFrame:
    """Rows of the groups that have every required modality."""
    have = rows.where(F.col(modality).isin(required)).groupBy(*keys).agg(F.count_distinct(modality).alias("_n")).where(F.col("_n") == len(set(required)))
    return rows.join(have.select(*keys), list(keys), "left_semi")


def balanced(rows: DataFrame, key: str, quality: str, order: str) -> DataFrame:
    """As many rows per key as the smallest key has, best quality first.

    The smallest count is one number joined to every row; its row is an aggregate, so the broadcast is of one row.
    """
    least = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_least"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(quality).desc_nulls_last(), order))
    return rows.withColumn("_rank", rank).crossJoin(F.broadcast(least)).where("_rank <= _least").drop("_rank", "_least")


def session_vectors(files: DataFrame, keys: list[str], modality: str, modalities: list[str], values: list[str], order: str, quality: str | None = None) -> DataFrame:
    """One wide row per session: of each modality the values of one file, named <modality>_<value>, and has_<modality>.

    With a quality, a session's best file counts, the first in order of equals; where no file of the modality has one, or
    without a quality, the last in order. A modality that a session lacks gives 0 and NULLs. Every session is kept; those
    with all of the modalities are where all flags are 1. One aggregation by session, no join per modality.
    """
    at = F.col(order).cast("double")
    rank = F.struct(F.lit(False), F.lit(0.0), at)
    if quality is not None:
        q = F.col(quality).cast("double")
        q = F.when(~F.isnan(q), q)
        rank = F.struct(q.isNotNull(), F.coalesce(q, F.lit(0.0)), F.when(q.isNull(), at).otherwise(-at))
    parts = []
    for m in modalities:
        own = F.col(modality) == m
        parts += [F.count_if(own).cast("boolean").cast("int").alias(f"has_{m}"), F.max_by(F.struct(*[F.col(v) for v in values]), F.when(own, rank)).alias(f"_{m}")]
    made = files.groupBy(*keys).agg(*parts)
    return made.select(*keys, *[F.col(f"has_{m}") for m in modalities], *[F.col(f"_{m}.{v}").alias(f"{m}_{v}") for m in modalities for v in values])
