"""Queries of the operators that judge or rewrite each text by itself: quality rules, language, licences, infilling, token alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..alignment import align_tokenizers
from ..common import table
from ..infill import fill_in_middle, restore
from ..langid import identify_languages
from ..licenses import known_licenses, scan_licenses
from ..quality import quality_rules
from .oracles import OP3, OP12


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return judged.select("doc_id", *[f"quality.{c}" for c in columns])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return identify_languages(table(spark, sf_dir, "documents"), held_out)


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), known_licenses(spark))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restore(F.col("infill.output"), F.col("infill.form"))
    digests = (F.sha2("infill.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
    return cut.select("doc_id", *[f"infill.{c}" for c in ("n", "form", "prefix_chars", "middle_chars")], *digests)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_tokenizers(table(spark, sf_dir, "documents"))
    groups = out.texts.select("text_id", F.when(F.col("groups") != "", F.sha2("groups", 256)).alias("groups_sha256"))
    measures = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return out.documents.join(groups, "text_id", "left").select("doc_id", *measures, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_license_scans, op12_fill_in_middle, op13_tokenizer_alignment)}
SQL = {"op3_license_scans": OP3, "op12_fill_in_middle": OP12}
