"""Queries of mixing sources, LM scoring and license scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumisift.llm import licenses, lm_score, mixing
from lumisift.llm.common import table


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows, pieces = mixing.mix_sources(table(spark, folder, "documents"))
    return mixing.taken_words(rows, pieces).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "labels").where("quality = 1")
    return lm_score.score_documents(table(spark, folder, "documents"), good)


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "allowed")


QUERIES = {"op1_mix_sources": op1_mix_sources, "op2_lm_score": op2_lm_score, "op7_license_scan": op7_license_scan}
SQL: dict[str, str] = {}
