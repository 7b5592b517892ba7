"""The driver's tables in the roles of a biosignal study.

events: user_id is the file, its n-th event the n-th sample, value the sample, 50 / (50 + value) its quality, event_type
the modality. orders and lineitem numbers are features, customers participants, o_totalprice the glucose value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, i, x, q, modality."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("value").alias("x"),
        (F.lit(50.0) / (F.lit(50.0) + F.col("value"))).alias("q"), F.col("event_type").alias("modality"))


SAMPLES_SQL = """
s AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x,
             50.0::DOUBLE / (50.0::DOUBLE + value) AS q, event_type AS modality FROM events)"""

#: Sample-rate of the driver's samples in the queries below.
FS = 1.0


def modality_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples numbered within (file_id, modality)."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), F.col("event_type").alias("modality"), (F.row_number().over(order) - 1).cast("long").alias("i"),
        F.col("value").alias("x"), (F.lit(50.0) / (F.lit(50.0) + F.col("value"))).alias("q"))


MODALITY_SAMPLES_SQL = """
s AS (SELECT user_id AS file_id, event_type AS modality, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i,
             value AS x, 50.0::DOUBLE / (50.0::DOUBLE + value) AS q FROM events)"""
