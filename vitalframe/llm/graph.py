"""Connected components of distributed links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vitalframe.llm.common import remove_folder, shared_folder, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link, root being the smallest node reachable.

    Large-star joins each node's larger neighbours to its smallest neighbour, small-star its smaller ones; they
    alternate until the links no longer change, some log of the longest path. Each step is two shuffles by node and one
    table in the shared folder, which takes the place of the step's before.
    """
    spark = links.sparkSession
    folder, step, before = f"{shared_folder(spark)}/links-{uuid.uuid4().hex}", 0, None
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")), f"{folder}/0")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        seen = Observation()
        step += 1
        made = small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        made = made.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        edges = written(made, f"{folder}/{step}")
        remove_folder(spark, f"{folder}/{step - 1}")
        now = (seen.get["n"], seen.get["s"])
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
