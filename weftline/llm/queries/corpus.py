"""Queries that set a training corpus together: mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..mixing import label_domains, mix
from ..packing import pack

WEIGHTS = {"clean": 0.9, "low": 0.05, "toxic": 0.05}


def op4_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), WEIGHTS)
    p = [F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(WEIGHTS)]
    return out.select("doc_id", "tokens", *p, "rate", "copies")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op4_mixing_weights, op8_packing)}
SQL: dict[str, str] = {}
