"""Queries of the operators on pairs: near-duplicate documents, lines and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..lines import dedup_lines
from ..maxscore import top_products
from ..minhash import near_duplicates
from ..vectors import near_vectors
from .oracles import OP5, OP9, OP11


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines.n_lines", "lines.n_kept", F.sha2("text", 256).alias("text_sha256"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES = {f.__name__: f for f in (op5_minhash_near_dedup, op6_line_dedup, op9_embedding_near_dedup, op11_exact_top_k)}
SQL = {"op5_minhash_near_dedup": OP5, "op9_embedding_near_dedup": OP9, "op11_exact_top_k": OP11}
