"""A training corpus from documents, in five stages; each works on all that the one before kept.

All stages but the last return the columns of ``documents``. The last returns the mix: for each
document how many words of it are taken, its source's target, and the first slot that takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumisift.llm.common import table
from lumisift.llm.decontaminate import clean_documents
from lumisift.llm.line_dedup import without_repeated_lines
from lumisift.llm.mixing import mix_sources, taken_words
from lumisift.llm.near_dup import one_of_each
from lumisift.llm.quality_model import good_documents
from lumisift.plans.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject; it learns from the labels of ``docs``."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in an earlier one; a document with no line left goes."""
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item stands."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, first_slot)`` of every document."""
    return taken_words(*mix_sources(docs)).drop("row")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
]

# Neither the model nor the edit distances can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
