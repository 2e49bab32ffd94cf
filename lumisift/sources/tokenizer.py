"""Tokenizer files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_SCHEMA = "model struct<vocab:map<string,int>,merges:array<string>>"


def read_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``vocab(token, id)`` and ``merges(rank, left, right)`` of a tokenizer JSON file.

    A merge is a pair ``["a", "b"]`` or a string ``"a b"``, parted at the first
    space; a string without a space is left out. An empty vocabulary is an error.
    """
    model = spark.read.schema(_SCHEMA).json(path, multiLine=True).select("model.*")
    vocab = model.select(F.explode("vocab").alias("token", "id"))
    if vocab.isEmpty():
        raise ValueError(f"no vocabulary in {path}")
    entries = model.select(F.posexplode("merges").alias("_entry", "_text"))
    pair = F.when(F.col("_text").startswith("["), F.from_json("_text", "array<string>"))
    is_pair = F.coalesce(F.size(pair) == 2, F.lit(False))
    space = F.instr("_text", " ")
    merges = entries.where(is_pair | (space > 0)).select(
        "_entry",
        F.when(is_pair, pair[0]).otherwise(F.expr("substring(_text, 1, instr(_text, ' ') - 1)")).alias("left"),
        F.when(is_pair, pair[1]).otherwise(F.expr("substring(_text, instr(_text, ' ') + 1)")).alias("right"),
    )
    # Ranks only have to keep the order of the file, and entries do.
    return vocab, merges.withColumnRenamed("_entry", "rank").select("rank", "left", "right")
