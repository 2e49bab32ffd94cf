"""Decisions that depend on how large an input is."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Spark's own default size of a split.
SPLIT_BYTES = 128 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the result; very large where it knows nothing."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_small(df: DataFrame, limit: int) -> bool:
    return estimated_bytes(df) <= limit


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for costly Python work on an input with less than a split per core.

    A larger input has enough splits as it is, and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if is_small(df, cores * SPLIT_BYTES) else df
