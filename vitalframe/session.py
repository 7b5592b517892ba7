"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    """ANSI arithmetic, adaptive plans with skew handling, Arrow on. Sizes are left to the cluster unless given."""
    b = SparkSession.builder.appName("vitalframe")
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | settings
    return b.config(map=conf).getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the folder that spark.checkpoint.dir names, without the plan that made them. A local session
    without one gets a folder of its own; on a cluster that is an error, since executors could not read each other's files."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vitalframe-checkpoint-"))
    return df.checkpoint()
