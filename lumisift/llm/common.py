"""What several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The characters between words; part of every contract on words.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def numbers_to(size: Column) -> Column:
    """``[0, ..., size - 1]``; empty for 0 and less."""
    none = F.array().cast("array<int>")
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(none)


def running_sums(values: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array of longs, in blocks so that the cost stays near linear."""
    none = F.array().cast("array<bigint>")

    def last(acc: Column) -> Column:
        return F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint"))

    def sums(part: Column) -> Column:
        return F.aggregate(part, none, lambda acc, x: F.concat(acc, F.array(last(acc) + x)))

    def whole(v: Column) -> Column:
        count = F.ceil(F.size(v) / F.lit(float(block))).cast("int")
        parts = F.transform(numbers_to(count), lambda b: sums(F.slice(v, b * block + 1, F.lit(block))))
        return let(parts, lambda blocks: let(
            sums(F.transform(blocks, last)),
            lambda totals: F.flatten(F.transform(blocks, lambda part, i: F.transform(
                part, lambda x: x + F.coalesce(F.get(totals, i - 1), F.lit(0).cast("bigint"))))),
        ))

    return let(values, whole)
