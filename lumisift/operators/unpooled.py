"""Searches whose cutoff sees every score, without a table of all pairs of query and image.

Otsu's threshold needs the counts and sums of the scores below each split, not the scores. Tasks count
scores into bins per query, the bins are added up, and the value of every split between two bins follows
exactly. Inside a bin the sums can only bend so far, which bounds the value of the splits there: bins that
could hold a better split are cut finer in another scan of the corpus, all others stay as they are. It ends
when no bin is left that could win, usually after two or three scans, whatever the number of images.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumisift.functions.paths import prefix_filter
from lumisift.functions.vectors import SCORE_DIGITS, noise_floor
from lumisift.operators.cutoff import MIN_SCORES, Cutoff, at_least, parse_cutoff
from lumisift.operators.topk import _SCORES_AT_ONCE, _SLACK, _bars, _result_type, merge_top, scan_all, slabs
from lumisift.plans.blocks import Block, Blocks, matrix_blocks
from lumisift.plans.running import in_ranges, running_totals
from lumisift.plans.scratch import materialize
from lumisift.plans.skew import group_join

BINS = 512
# Bins that a task holds before it adds them up or hands them on.
HELD_BINS = 2_000_000
_CLOSE = 1e-9


def reaching(vectors: DataFrame, blocks: Blocks, query_id: str) -> DataFrame:
    """``(query_id, image_id, score)`` of all pairs whose score reaches the query's ``bar``."""
    walk, schema = blocks.walk(), _result_type(blocks.table.schema[blocks.key].dataType, query_id)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in slabs(batches, walk.dim):
            for block in walk:
                bars = _bars(block)[:, None] - _SLACK
                for low, scores in _scores(block, matrix):
                    query, row = np.nonzero(scores >= bars)
                    rounded = np.round(scores[query, row], SCORE_DIGITS)
                    yield pa.RecordBatch.from_arrays(
                        [block.keys.take(pa.array(query)), pa.array(ids[low + row]), pa.array(rounded)], names=schema.fieldNames())

    return vectors.select("image_id", "embedding").mapInArrow(scan, schema)


def _scores(block: Block, matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, _SCORES_AT_ONCE // max(len(block.keys), 1))
    for low in range(0, len(matrix), step):
        yield low, block.matrix @ matrix[low:low + step].T


class _Tally:
    """Counts, sums and bounds of scores by block, query and bin."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.keys: dict[int, pa.Array] = {}
        self.waiting = 0

    def add(self, block: Block, scores: np.ndarray) -> None:
        self.keys[block.number] = block.keys
        edges, opened = block.extra["edges"], block.extra["opened"]
        lowest = np.array([e[0] for e in edges])
        query, row = np.nonzero(scores >= lowest[:, None] - _SLACK)
        values = np.round(scores[query, row], SCORE_DIGITS)
        starts = np.searchsorted(query, np.arange(len(edges) + 1))
        place = np.empty(len(values))
        for q, (a, b) in enumerate(zip(starts, starts[1:])):
            at = np.searchsorted(edges[q], values[a:b], side="right") - 1
            place[a:b] = np.where(at < 0, -1, 2 * at + opened[q][at])
        there = place >= 0
        number = np.full(there.sum(), float(block.number))
        one = np.ones(there.sum())
        values = values[there]
        self._take(np.array([number, query[there], place[there], one, values, values, values]))

    def _take(self, part: np.ndarray) -> None:
        self.parts.append(_added_up(part))
        self.waiting += self.parts[-1].shape[1]

    def full(self) -> bool:
        """Whether the bins, added up, are still too many to hold."""
        if self.waiting > HELD_BINS:
            self.parts = [_added_up(np.concatenate(self.parts, axis=1))]
            self.waiting = self.parts[0].shape[1]
        return self.waiting > HELD_BINS // 2

    def out(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        whole = _added_up(np.concatenate(self.parts, axis=1))
        for number in np.unique(whole[0]):
            _, query, place, n, total, low, high = whole[:, whole[0] == number]
            keys = self.keys[int(number)].take(pa.array(query.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(place.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(total), pa.array(low), pa.array(high)], names=names)
        self.parts, self.waiting = [], 0


def _added_up(part: np.ndarray) -> np.ndarray:
    """Columns of ``(block, query, place, n, total, low, high)``, one for each block, query and place."""
    if not part.shape[1]:
        return part
    part = part[:, np.lexsort(part[2::-1])]
    first = np.flatnonzero(np.r_[True, (part[:3, 1:] != part[:3, :-1]).any(axis=0)])
    return np.array([
        *part[:3, first], np.add.reduceat(part[3], first), np.add.reduceat(part[4], first),
        np.minimum.reduceat(part[5], first), np.maximum.reduceat(part[6], first)])


def count_scores(vectors: DataFrame, blocks: Blocks, query_id: str) -> DataFrame:
    """``(query_id, place, n, total, low, high)`` of the scores in each bin of a query's ``edges``; empty bins are left out.

    ``place`` is twice the number of the bin, and one more where ``opened`` has a one for it.
    """
    walk = blocks.walk()
    schema = T.StructType([
        T.StructField(query_id, blocks.table.schema[blocks.key].dataType), T.StructField("place", T.IntegerType()),
        T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("total", "low", "high")]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for _, matrix in slabs(batches, walk.dim):
            for block in walk:
                for _, scores in _scores(block, matrix):
                    tally.add(block, scores)
                    if tally.full():
                        yield from tally.out(schema.fieldNames())
        yield from tally.out(schema.fieldNames())

    counted = vectors.select("image_id", "embedding").mapInArrow(scan, schema)
    return counted.groupBy(query_id, "place").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def judged(
    place: np.ndarray, n: np.ndarray, total: np.ndarray, low: np.ndarray, high: np.ndarray, floor: float
) -> tuple[float | None, list[float] | None, list[int] | None]:
    """The threshold of bins in order, or where to cut them next: ``(threshold, edges, opened)``.

    Neighbours that hold no better split become one bin, which is never opened again.
    """
    if n.sum() < MIN_SCORES:
        return floor, None, None
    upto, summed = np.r_[0.0, np.cumsum(n)], np.r_[0.0, np.cumsum(total)]
    size, whole = upto[-1], summed[-1]
    # How far the sum below a split stays behind that of as many average scores.
    behind = np.maximum(whole * upto - summed * size, 0.0)
    behind[-1] = 0.0

    def spread(w: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.where((w > 0) & (w < size), d * d / np.maximum(w * (size - w), 1e-300), 0.0)

    between = spread(upto, behind)
    best = between.max()
    # Inside a bin what is behind grows by at most ``rise`` per score at first, and by at least ``fall`` in the end.
    rise, fall = whole - size * low, whole - size * high
    a, b, at_a, at_b = upto[:-1], upto[1:], behind[:-1], behind[1:]
    wide = high > low
    peak = np.where(wide, (at_b - b * fall - at_a + a * rise) / np.where(wide, rise - fall, 1.0), a)
    peak = np.clip(peak, a, b)
    bound = np.maximum(between[:-1], between[1:])
    for offset, slope, lowest, highest in ((at_a - a * rise, rise, a, peak), (at_b - b * fall, fall, peak, b)):
        turn = size * slope + 2 * offset
        still = np.where(turn != 0, offset * size / np.where(turn != 0, turn, 1.0), lowest)
        for w in (lowest, np.clip(still, lowest, highest), highest):
            bound = np.maximum(bound, spread(w, np.maximum(offset + slope * w, 0.0)))
    open_ = wide & (place % 2 == 1) & (bound >= best * (1 - _CLOSE)) & (bound > 0)
    if not open_.any():
        if best <= 0:
            return max(floor, float(low[0])), None, None
        split = int(np.argmax(between)) - 1
        return max(floor, float((high[split] + low[split + 1]) / 2)), None, None
    parts = max(2, BINS // int(open_.sum()))
    edges: list[float] = []
    opened: list[int] = []
    for i in range(len(n)):
        if open_[i]:
            edges += np.linspace(low[i], high[i], parts + 1)[:-1].tolist()
            opened += [1] * parts
        elif not edges or open_[i - 1] or between[i] >= best * (1 - _CLOSE):
            edges.append(float(low[i]))
            opened.append(0)
    return None, edges, opened


def all_thresholds(vectors: DataFrame, blocks: Blocks, floor: float, query_id: str = "query_id") -> DataFrame:
    """``(query_id, threshold)`` of each query over the scores of all ``vectors``: the rule of ``otsu_threshold``.

    A query without scores above the floor has the floor.
    """
    every = blocks.table.select(F.col(blocks.key).alias(query_id), F.col(blocks.vector).alias("embedding"))
    schema = T.StructType([
        every.schema[query_id], T.StructField("threshold", T.DoubleType()), T.StructField("edges", T.ArrayType(T.DoubleType())),
        T.StructField("opened", T.ArrayType(T.IntegerType()))])

    def judge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        found = judged(*(table.column(c).to_numpy().astype(float) for c in ("place", "n", "total", "low", "high")), floor)
        types = (key[0].type, pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()))
        return pa.table([pa.array([v], t) for v, t in zip((key[0].as_py(), *found), types)], names=schema.fieldNames())

    first = [float(e) for e in np.linspace(floor, max(1.0, floor + 1e-6), BINS)]
    edges = every.select(query_id, F.lit(first).alias("edges"), F.lit([1] * BINS).alias("opened"))
    done = []
    while True:
        asked = matrix_blocks(every.join(edges, query_id), query_id, "embedding", blocks.dim, ("edges", "opened"))
        result = materialize(
            count_scores(vectors, asked, query_id).groupBy(query_id).applyInArrow(judge, schema), "thresholds")
        done.append(result.where("threshold IS NOT NULL").drop("edges", "opened"))
        edges = result.where("threshold IS NULL").drop("threshold")
        if edges.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return every.select(query_id).join(found, query_id, "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(float(floor))))


def search_all(
    blocks: Blocks, vectors: DataFrame, manifest: DataFrame, directory: str, limit: int, cutoff: Cutoff,
    sigmas: float, query_id: str = "query_id",
) -> DataFrame:
    """:func:`lumisift.operators.search.search` over all images under ``directory``, with no pool in between."""
    cutoff = parse_cutoff(cutoff)
    inside = prefix_filter(manifest.where(F.col("path") != ""), directory).select("image_id", "path")
    vectors = vectors.join(inside.select("image_id"), "image_id", "left_semi")
    if cutoff == "auto":
        floor = noise_floor(max(blocks.dim, 1), sigmas)
        thresholds = materialize(all_thresholds(vectors, blocks, floor, query_id), "thresholds")
    else:
        bar = F.lit(0.0 if cutoff == "none" else float(cutoff))
        thresholds = blocks.table.select(F.col(blocks.key).alias(query_id), bar.alias("threshold"))
    bars = thresholds.select(F.col(query_id).alias(blocks.key), F.col("threshold").alias("bar"))
    blocks = blocks.adding(bars)
    if limit > 0:
        hits = merge_top(scan_all(vectors, blocks, limit, query_id), limit, query_id).drop("rank")
    else:
        hits = reaching(vectors, blocks, query_id)
    passed = group_join(hits, thresholds, [query_id], "image_id").where(at_least("score", F.col("threshold")))
    found = passed.drop("threshold").join(inside, "image_id")
    if limit > 0:
        ranked = merge_top(found, limit, query_id)
    else:
        ordered = in_ranges(found.withColumn("_order", _place()), [query_id], "_order")
        ranked = running_totals(ordered, [query_id], "_order", {"rank": F.lit(1).cast("long")})
        ranked = ranked.withColumn("rank", F.col("rank").cast("int"))
    return ranked.select(query_id, "rank", "score", "path", "image_id")


def _place() -> Column:
    return F.struct(-F.col("score"), "image_id")
