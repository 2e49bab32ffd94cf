"""Running totals over a global order, without one task seeing a whole group.

Spark's own window function puts a whole ``partitionBy`` group into one task.
That is right for groups of known size. For groups without a bound the rows are
range-partitioned instead; each range is summed on its own, and what the earlier
ranges of the group add up to is carried in through a join with one row per
(group, range).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumisift.plans.scratch import materialize
from lumisift.plans.size import is_small

# An input estimated at no more than this is one task's work at most.
ONE_TASK_BYTES = 16 * 1024 * 1024

_RANGE = "_range"


def in_ranges(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """``df`` stored in ranges of ``(by, order)``; small inputs stay one range."""
    if is_small(df, ONE_TASK_BYTES):
        return materialize(df.withColumn(_RANGE, F.lit(0)), "ranges")
    ranged = df.repartitionByRange(*by, order).withColumn(_RANGE, F.spark_partition_id())
    return materialize(ranged, "ranges")


def running_totals(
    ranged: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    following: str | None = None,
) -> DataFrame:
    """Add one inclusive running total per entry of ``sums`` to a table from :func:`in_ranges`.

    ``order`` must be unique within a group: aggregate equal values first. With
    ``following``, that column holds the next value of ``order`` in the group.
    """
    kept = [c for c in ranged.columns if c != _RANGE]
    ranged = ranged.select("*", *[value.alias(name) for name, value in sums.items()])
    keys = [*by, _RANGE]
    ranges = ranged.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in sums], F.min(order).alias("_first")
    )
    # One row per (group, range): at most ranges + groups rows in all.
    in_group = Window.partitionBy(*by).orderBy(_RANGE)
    before = in_group.rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(
        *keys,
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_carry_{name}") for name in sums],
        F.lead("_first").over(in_group).alias("_next_first"),
    )
    local = Window.partitionBy(*keys).orderBy(order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.select(
        *kept,
        _RANGE,
        *[F.sum(name).over(upto).alias(name) for name in sums],
        F.lead(order).over(local).alias("_next"),
    )
    joined = inside.join(carried, keys)
    out = [F.col(c) for c in kept]
    out += [(F.col(name) + F.col(f"_carry_{name}")).alias(name) for name in sums]
    if following:
        out.append(F.coalesce("_next", "_next_first").alias(following))
    return joined.select(*out)


def dense_ids(df: DataFrame, order: str, start: int, name: str = "image_id") -> DataFrame:
    """Number rows ``start, start+1, ...`` by the unique column ``order``."""
    if is_small(df, ONE_TASK_BYTES):
        place = F.row_number().over(Window.orderBy(order)).cast("long")
        return df.withColumn(name, place + F.lit(start - 1))
    ranged = in_ranges(df, [], order)
    numbered = running_totals(ranged, [], order, {"_position": F.lit(1).cast("long")})
    return numbered.withColumn(name, F.col("_position") + F.lit(start - 1)).drop("_position")
