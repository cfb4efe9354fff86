"""What the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import components, saved, shared_dir

__all__ = ["WORD", "components", "saved", "shared_dir", "table"]

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
