"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled into a stream of words, which is cut into blocks of
equal size and starts again when it ends. A source gets as many slots as blocks it needs.
The slots of all sources lie one after the other on a line, in proportion to the targets;
the points of the van der Corput sequence visit the line, so every stretch of the
schedule holds each source in about its share. The slots of a source are ranked in the
order of the visit, and the slot of rank r takes block r.

No window spans a source: a source with a third of all documents is cut into ranges, and
totals of earlier ranges are carried in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumisift.llm.common import WORD, text_of
from lumisift.plans.running import in_ranges, running_totals
from lumisift.plans.scratch import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 512

# Slots that one row is unfolded to at a time.
_CHUNK = 1 << 14


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def with_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources(source, source_size)`` with ``sid`` (rank by code point from 0, null last) and ``target``.

    Weights repeat in the order of ``sid``. The targets share ``share`` times all sizes by weight; one
    that would pass ``most`` times its source's size stops there, and the others share the rest. In order
    of size per weight those that stop come first, so running sums give the level of the others.
    """
    named = sources.withColumn("_by", F.struct(F.col("source").isNull().alias("n"), F.col("source").alias("s")))
    ranked = running_totals(in_ranges(named, [], "_by"), [], "_by", {"_place": F.lit(1).cast("bigint")})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", (F.col("_place") - 1).alias("sid")).withColumn("_w", weight)
    cap = (F.col("source_size") * most).cast("double")
    by_need = ranked.withColumn("_need", F.struct((cap / F.col("_w")).alias("ratio"), F.col("sid").alias("sid")))
    summed = materialize(running_totals(in_ranges(by_need, [], "_need"), [], "_need", {
        "_caps": F.col("source_size") * most, "_ws": F.col("_w").cast("bigint")}), "mix-sources")
    all_w, all_size = summed.agg(F.sum("_w"), F.sum("source_size")).first()
    before = F.col("_caps") - F.col("source_size") * most
    left = F.lit(share) * F.lit(all_size or 0) - before
    over = F.lit(all_w or 0) - (F.col("_ws") - F.col("_w"))
    # Whether a source would stay below its cap if all before it had stopped: from the first such on, all do.
    first = summed.where(left * F.col("_w") < cap * over).agg(
        F.min_by(F.struct(left.alias("left"), over.cast("double").alias("over"), F.col("_need").alias("need")), "_need")
    ).first()[0]
    target = cap
    if first is not None:
        shared = F.col("_w") * F.lit(first["left"]) / F.lit(first["over"])
        beyond = (F.col("_need.ratio") > first["need"]["ratio"]) | (
            (F.col("_need.ratio") == first["need"]["ratio"]) & (F.col("sid") >= first["need"]["sid"]))
        target = F.when(beyond, F.least(shared, cap)).otherwise(cap)
    return summed.select("source", "source_size", "sid", target.alias("target"))


def reversed_bits(number: Column, bits: int) -> Column:
    """The van der Corput index of a position on a line of ``2 ** bits``."""
    return F.conv(F.reverse(F.lpad(F.bin(number), bits, "0")), 2, 10).cast("bigint")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """``(slot, sid, rank)``: which source fills each slot, and with its how-many-th block.

    ``sources`` has ``sid`` and ``words``, the words that the mix is to take. ``slot`` orders the schedule;
    it is not dense, as the line is filled up to a power of two.
    """
    need = sources.withColumn("_slots", F.ceil(F.col("words") / F.lit(float(block))).cast("bigint"))
    placed = materialize(running_totals(
        in_ranges(need.select("sid", "_slots"), [], "sid"), [], "sid", {"_end": F.col("_slots")}), "mix-line")
    total = placed.agg(F.max("_end")).first()[0] or 0
    bits = max(1, (total - 1).bit_length()) if total else 1
    chunks = placed.where("_slots > 0").select(
        "sid", "_end", F.explode(F.sequence(F.col("_end") - F.col("_slots"), F.col("_end") - 1, F.lit(_CHUNK))).alias("_at"))
    spread = chunks.repartition("sid", "_at")
    at = spread.select("sid", F.explode(
        F.sequence(F.col("_at"), F.least(F.col("_at") + (_CHUNK - 1), F.col("_end") - 1))).alias("_at"))
    slots = at.select("sid", reversed_bits(F.col("_at"), bits).alias("slot"))
    ranked = running_totals(in_ranges(slots, ["sid"], "slot"), ["sid"], "slot", {"_nth": F.lit(1).cast("bigint")})
    return ranked.select("slot", "sid", (F.col("_nth") - 1).alias("rank"))


def streams(docs: DataFrame, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Documents at their place in the shuffled stream of their source, and the size of each source.

    The first table has ``(row, doc_id, source, size, part, place)``, where ``place`` counts the words in
    front within a part of the source; the second has ``(source, part, before, source_size)``.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(key)).alias("_mixed"))
    ranged = rows.repartitionByRange("source", "_mixed", "doc_id").withColumn("part", F.spark_partition_id())
    stored = materialize(ranged.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    ahead = Window.partitionBy("source", "part").orderBy("_mixed", "doc_id", "row")
    placed = stored.withColumn("place", F.sum("size").over(
        ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).drop("_mixed")
    # One row per source and part: as many as parts and sources together, at most.
    parts = stored.groupBy("source", "part").agg(F.sum("size").alias("_size"))
    within = Window.partitionBy("source")
    before = F.sum("_size").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = parts.select("source", "part", (before - F.col("_size")).alias("before"),
                         F.sum("_size").over(within).alias("source_size"))
    return placed, materialize(parts, "mix-parts")


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
    block: int = BLOCK_WORDS, seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The documents with their sources' targets, and the pieces of them that the mix takes, by slot.

    Documents: ``(row, doc_id, source, size, source_size, target)``, one row for each of ``docs``; ``row`` tells
    repeated ones apart. Pieces: ``(slot, row, doc_id, first, last)``, words from ``first`` up to before ``last`` of
    a document, where a second pass through it counts on from its size. A source's pieces have its target, rounded
    down, in words; as no target is over ``most`` times its source's size, nor is any document taken more often.
    Null sources are a source; empty and null texts have no words and no pieces. Other columns are not looked at.
    """
    placed, parts = streams(docs, seed)
    targets = with_targets(parts.select("source", "source_size").distinct(), weights, share, most)
    targets = materialize(targets.withColumn("words", F.floor("target").cast("bigint")), "mix-targets")
    slots = materialize(schedule(targets, block), "mix-slots")

    facts = targets.select(F.col("source").alias("_s"), "sid", "source_size", "target", "words")
    facts = parts.drop("source_size").join(facts, F.col("source").eqNullSafe(F.col("_s"))).select(
        "_s", F.col("part").alias("_p"), "before", "sid", "source_size", "target", "words")
    rows = placed.join(facts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    rows = rows.withColumn("_from", F.col("before") + F.col("place"))

    pass_no = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(most)])).alias("_pass")
    passed = rows.where("size > 0").select(
        "row", "doc_id", "sid", "size", "words", "source_size", "_from", pass_no)
    low = F.col("_from") + F.col("_pass") * F.col("source_size")
    passed = passed.withColumn("_low", low).withColumn("_high", F.least(low + F.col("size"), F.col("words")))
    cut = passed.where("_low < _high").select(
        "row", "doc_id", "sid", "size", "_pass", "_low", "_high",
        F.explode(F.sequence(F.floor(F.col("_low") / block), F.floor((F.col("_high") - 1) / block))).alias("rank"))
    shift = F.col("_low") - F.col("_pass") * F.col("size")
    pieces = cut.join(slots, ["sid", "rank"]).select(
        "slot", "row", "doc_id",
        (F.greatest(F.col("_low"), F.col("rank") * block) - shift).alias("first"),
        (F.least(F.col("_high"), (F.col("rank") + 1) * block) - shift).alias("last"))
    return rows.select("row", "doc_id", "source", "size", "source_size", "target"), pieces


def taken_words(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """``rows`` of :func:`mix_sources` with ``taken``, the words the mix takes, and ``first_slot``."""
    sums = pieces.groupBy("row").agg(
        F.sum(F.col("last") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"))
    return rows.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))
