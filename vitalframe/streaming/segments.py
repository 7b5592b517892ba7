"""Structured Streaming forms of segmentation and windows; beyond what a batch study needs.

Samples arrive with an event time. A quality run is a session of good samples; sample windows become time windows.
State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.functions.nulls import clean_num, meets


def streaming_runs(samples: DataFrame, threshold: float, gap: str, late: str, time: str = "ts", key: str = "file_id", q: str = "q") -> DataFrame:
    """Sessions of samples at or above the threshold: a pause of `gap` without a good sample ends a run."""
    good = samples.where(meets(q, threshold)).withWatermark(time, late)
    return good.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("duration"), F.avg(q).alias("quality_indicator")).select(
        key, F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "duration", "quality_indicator")


def streaming_windows(samples: DataFrame, size: str, shift: str, late: str, time: str = "ts", key: str = "file_id", q: str = "q") -> DataFrame:
    """Sliding time windows with the mean quality of their samples."""
    rows = samples.withWatermark(time, late)
    return rows.groupBy(F.window(time, size, shift).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(clean_num(q)).alias("quality_indicator")).select(
        key, F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "n", "quality_indicator")
