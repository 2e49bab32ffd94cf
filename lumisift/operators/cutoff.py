"""Score cutoffs: fixed, none, and adaptive (Otsu's method above a noise floor)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumisift.plans.running import in_ranges, running_totals
from lumisift.plans.skew import group_join

# Fixed value: fewer scores than this have no distribution to split.
MIN_SCORES = 3

Cutoff = str | float


def parse_cutoff(text: Cutoff) -> Cutoff:
    """``auto``, ``none`` or a number."""
    if text in ("auto", "none"):
        return text
    try:
        return float(text)
    except ValueError:
        raise ValueError(f"{text!r} is no cutoff: neither auto nor none nor a number") from None


def at_least(value: str, threshold: Column | float) -> Column:
    """``value >= threshold`` where NaN is below everything."""
    bar = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (F.col(value) >= bar) & ~F.isnan(F.col(value))


def otsu_threshold(
    scores: DataFrame, by: Sequence[str], floor: float, score: str = "score"
) -> DataFrame:
    """``threshold`` per group: the split of the scores into two classes that differ most.

    Scores under ``floor`` do not count. Of fewer than three others the threshold
    is ``floor``. Splits are ranked by ``w0 * w1 * (mean0 - mean1)^2`` and the lowest
    of the best ones wins; the threshold lies halfway between its two scores.

    Equal scores are never worth splitting, so ``scores`` is read once to count distinct
    ones, and groups of any size go through running totals over ranges of scores.
    """
    by = list(by)
    counted = scores.groupBy(*by, F.when(at_least(score, floor), F.col(score)).alias("_s")).agg(
        F.count("*").alias("_n"))
    ranged = in_ranges(counted, by, "_s")
    # Scores that do not count are one null per group, which keeps the group.
    n = F.when(F.col("_s").isNull(), 0).otherwise(F.col("_n"))
    weight = F.coalesce(n * F.col("_s"), F.lit(0.0))
    totals = ranged.groupBy(*by).agg(
        F.sum(n).alias("_total_n"), F.sum(weight).alias("_total"), F.min("_s").alias("_lowest"))
    running = running_totals(ranged, by, "_s", {"_w0": n, "_sum0": weight}, following="_next")
    splits = running.where(F.col("_s").isNotNull() & F.col("_next").isNotNull())
    best = (
        group_join(splits, totals, by, "_s")
        .withColumn("_spread", _between("_w0", "_sum0", "_total_n", "_total"))
        .where(F.col("_spread") > 0)
        .groupBy(*by)
        .agg(F.max_by((F.col("_s") + F.col("_next")) / 2, _first_best("_spread", "_w0")).alias("_split"))
    )
    return totals.join(best, by, "left").select(
        *by, _threshold("_total_n", "_split", "_lowest", floor).alias("threshold"))


def _between(w0: str, sum0: str, n: str, total: str) -> Column:
    w1 = F.col(n) - F.col(w0)
    gap = F.col(sum0) / F.col(w0) - (F.col(total) - F.col(sum0)) / w1
    return F.col(w0) * w1 * gap * gap


def _first_best(spread: str, w0: str) -> Column:
    return F.struct(F.col(spread), -F.col(w0))


def _threshold(n: str, split: str, lowest: str, floor: float) -> Column:
    chosen = F.greatest(F.coalesce(F.col(split), F.col(lowest)), F.lit(float(floor)))
    return F.when(F.col(n) >= MIN_SCORES, chosen).otherwise(F.lit(float(floor)))


def pool_threshold(pool: DataFrame, by: str, floor: float, score: str = "score") -> DataFrame:
    """Add ``threshold`` to the rows of candidate pools, which are bounded by their size rule.

    Same rule as :func:`otsu_threshold`, as windows over one shuffle on ``by``.
    """
    group = Window.partitionBy(by)
    # Rows that do not count sort first, as nulls, and add nothing to the sums.
    ordered = group.orderBy(F.asc_nulls_first("_s"), "image_id")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = pool.withColumn("_s", F.when(at_least(score, floor), F.col(score)))
    summed = counted.select(
        "*",
        F.count("_s").over(upto).alias("_w0"),
        F.sum("_s").over(upto).alias("_sum0"),
        F.lead("_s").over(ordered).alias("_next"),
        F.count("_s").over(group).alias("_total_n"),
        F.sum("_s").over(group).alias("_total"),
        F.min("_s").over(group).alias("_lowest"),
    )
    spread = summed.withColumn(
        "_spread",
        F.when(F.col("_s") < F.col("_next"), _between("_w0", "_sum0", "_total_n", "_total")),
    )
    key = F.when(F.col("_spread") > 0, _first_best("_spread", "_w0"))
    split = F.max_by((F.col("_s") + F.col("_next")) / 2, key).over(group)
    return (
        spread.withColumn("_split", split)
        .withColumn("threshold", _threshold("_total_n", "_split", "_lowest", floor))
        .select(*pool.columns, "threshold")
    )


def apply_cutoff(
    scores: DataFrame,
    cutoff: Cutoff,
    floor: float,
    by: str = "query_id",
    pooled: bool = False,
) -> DataFrame:
    """Rows of ``scores`` that pass the cutoff; ``none`` still drops scores below zero.

    ``pooled=True`` says that they are candidate pools, whose size rule bounds them.
    """
    cutoff = parse_cutoff(cutoff)
    if cutoff != "auto":
        return scores.where(at_least("score", 0.0 if cutoff == "none" else cutoff))
    if pooled:
        judged = pool_threshold(scores, by, floor)
    else:
        judged = group_join(scores, otsu_threshold(scores, [by], floor), [by], "image_id")
    return judged.where(at_least("score", F.col("threshold"))).drop("threshold")

