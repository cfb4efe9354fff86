"""Intermediate tables in the shared folder, and connected components by joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's ``spark.checkpoint.dir``; only a local session may go without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing stands at yet."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def saved(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The frame written once to the shared folder and read back: cuts lineage and outlives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` of long ids, as (id, component) with the smallest id of each.

    Alternates large-star and small-star steps, which keep connectivity and turn each
    component into a star round its smallest id in a logarithmic number of rounds. An
    id's neighbours are never gathered: a step takes a minimum per id (pre-aggregated)
    and joins it back, so a hub only makes a long join side, which adaptive execution
    splits. Each round is a saved table. Edges with a null end and loops are ignored.
    """
    current = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        # stars all over: every id has one neighbour below it at most, which has none
        ends = current.select(F.col("u").alias("id"), F.lit(1).alias("up")).union(current.select("v", F.lit(0)))
        if ends.groupBy("id").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 1 OR (ups = 1 AND n > 1)").isEmpty():
            break
        both = current.select("u", "v").union(current.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        current = saved(small.distinct())
    else:
        raise RuntimeError("components did not converge")
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
