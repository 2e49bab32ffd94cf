"""Joins with a table that is unique on the key, when some keys are hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lumisift.plans.size import is_small

HOT_SHARE = 512
SLICES = 32

# Of an input estimated at no more than this, even a key with all rows is one task's work.
ONE_TASK_BYTES = 64 * 1024 * 1024

# Keys of an input estimated at no more than this are broadcast.
BROADCAST_BYTES = 16 * 1024 * 1024


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Join ``left`` to a large ``right`` (unique on ``key``) so that no hot key fills one task.

    A key is hot when it holds more than 1/512 of the rows of ``left``. There are
    fewer than 512 such keys, so their matches in ``right`` are fewer than 512
    rows and can always be broadcast: hot rows are joined where they lie. All
    other rows take the ordinary join, whose shuffle now has no hot key.

    A large ``left`` is read three times: pass a stored table when it is costly to compute.
    """
    if is_small(left, ONE_TASK_BYTES):
        return left.join(right, key, how)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = counts.where(F.col("_n") * HOT_SHARE > total).select(key, F.lit(True).alias("_hot"))

    marked = left.join(F.broadcast(hot), key, "left")
    cold_rows = marked.where(F.col("_hot").isNull()).drop("_hot")
    hot_rows = marked.where(F.col("_hot")).drop("_hot")
    hot_right = right.join(F.broadcast(hot.select(key)), key, "left_semi")

    cold = cold_rows.join(right, key, how)
    return cold.unionByName(hot_rows.join(F.broadcast(hot_right), key, how))


def group_join(df: DataFrame, groups: DataFrame, by: Sequence[str], spread: str) -> DataFrame:
    """Give every row of ``df`` the one row its group has in ``groups``.

    Each row of ``groups`` is copied to 32 slices and each group of ``df`` is cut
    into 32 by a hash of ``spread``, so a group with a third of all rows is joined
    by many tasks. Spark broadcasts ``groups`` instead when it turns out small.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(SLICES)))
    copies = groups.withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long")))
    )
    return sliced.join(copies, [*by, "_slice"]).drop("_slice")


def asked_for(table: DataFrame, asking: DataFrame, key: str) -> DataFrame:
    """Rows of a large ``table`` whose key occurs in ``asking``, if that is small; else all.

    An outer or anti join from a few rows to a large table would shuffle the table.
    Cut down first, by a broadcast of keys of checked size, it stays where it is.
    """
    if not is_small(asking, BROADCAST_BYTES):
        return table
    return table.join(F.broadcast(asking.select(key)), key, "left_semi")
