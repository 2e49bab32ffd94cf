"""Queries of near-duplicate documents, line dedup, benchmark decontamination and the quality model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumisift.llm.common import table
from lumisift.llm.decontaminate import find_benchmark
from lumisift.llm.line_dedup import dedup_lines
from lumisift.llm.near_dup import near_duplicates
from lumisift.llm.quality_model import score_quality


def op3_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents"))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return find_benchmark(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


QUERIES = {
    "op3_quality_model": op3_quality_model,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_minhash": op6_minhash,
}
SQL: dict[str, str] = {}
