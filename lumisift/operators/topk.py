"""Top-k by cosine.

The corpus is scanned once and never shuffled, however many queries there are. Some of its splits,
about the square root of their number, are searched first: the k-th best score found there is a bar
that keeps nearly all other rows from leaving the scan. What passes is merged in two steps, first
per slice of the ids and then per query, so that no task has to merge the output of all others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lumisift.functions.vectors import SCORE_DIGITS, score
from lumisift.plans.blocks import Block, Blocks, Walk, matrix_blocks, vector_rows
from lumisift.plans.scratch import materialize
from lumisift.plans import size
from lumisift.plans.size import is_small
from lumisift.plans.skew import ONE_TASK_BYTES, group_join, lookup_join

MERGE_SLICES = 64
_SCORES_AT_ONCE = 8_000_000
_CANDIDATES = 100_000
_SLACK = 10.0 ** -(SCORE_DIGITS - 1)

# Vectors that a task holds while it walks through more blocks of queries than one.
SLAB_ROWS = 16_384
# A corpus of fewer splits is not searched for bars first.
LEAST_SPLITS = 16

# Given the rows of one Arrow batch, the (queries, rows) index pairs to be scored
# together; None stands for all.
Matcher = Callable[[pa.RecordBatch, np.ndarray], Iterator[tuple[np.ndarray | None, np.ndarray | None]]]


class Best:
    """The best k rows per query of those added so far.

    Candidates are collected and cut back to k per query now and then. In between
    ``bar`` keeps out what cannot be among them: each query has seen k scores that
    reach it.
    """

    def __init__(self, queries: int, k: int, bar: np.ndarray | None = None):
        self.k = k
        self.bar = np.full(queries, -np.inf) if bar is None else bar.copy()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.enough = max(queries * k, _CANDIDATES)

    def add(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in ``scores[i, j]`` of query ``which[i]`` and row ``ids[j]``."""
        # NaN compares as false.
        reach = scores >= self.bar[which][:, None] - _SLACK
        if scores.shape[1] > self.k and np.count_nonzero(reach) > 2 * self.k * len(which):
            place = scores.shape[1] - self.k
            clean = np.where(np.isnan(scores), -np.inf, scores)
            kth = np.partition(clean, place, axis=1)[:, place]
            self.bar[which] = np.maximum(self.bar[which], kth)
            reach = scores >= self.bar[which][:, None] - _SLACK
        rows, cols = np.nonzero(reach)
        if rows.size:
            rounded = np.round(scores[rows, cols], SCORE_DIGITS)
            self.parts.append((which[rows], ids[cols], rounded))
            self.waiting += rows.size
            if self.waiting > self.enough:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best as ``(query, id, score)``, ordered by query, score and id."""
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        query, ids, score = (np.concatenate(column) for column in zip(*self.parts))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(query.size) - np.searchsorted(query, query, side="left")
        last = place == self.k - 1
        self.bar[query[last]] = np.maximum(self.bar[query[last]], score[last])
        kept = place < self.k
        best = query[kept], ids[kept], score[kept]
        self.parts, self.waiting = [best], 0
        return best


def _result_type(keys: T.DataType, query_id: str) -> T.StructType:
    return T.StructType([
        T.StructField(query_id, keys),
        T.StructField("image_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ])


def _bars(block: Block) -> np.ndarray:
    """What scores have to reach; without a bar all of them do."""
    given = block.extra.get("bar")
    if given is None:
        return np.full(len(block.keys), -np.inf)
    return np.array([-np.inf if bar is None else bar for bar in given], float)


def _found(block: Block, best: Best, schema: T.StructType) -> pa.RecordBatch:
    which, ids, score = best.cut()
    return pa.RecordBatch.from_arrays(
        [block.keys.take(pa.array(which)), pa.array(ids), pa.array(score)], names=schema.fieldNames())


def _score(best: Best, block: Block, ids: np.ndarray, matrix: np.ndarray,
           which: np.ndarray | None = None, rows: np.ndarray | None = None) -> None:
    """Show ``best`` the scores of the given queries and rows, some at a time."""
    which = np.arange(len(block.keys)) if which is None else which
    rows = np.arange(len(ids)) if rows is None else rows
    step = max(1, _SCORES_AT_ONCE // max(len(which), 1))
    for low in range(0, len(rows), step):
        part = rows[low:low + step]
        best.add(which, ids[part], block.matrix[which] @ matrix[part].T)


def scan_top(
    vectors: DataFrame,
    block: Block,
    k: int,
    query_id: str,
    matcher: Matcher | None = None,
    carry: tuple[str, ...] = (),
    every: int = 1,
) -> DataFrame:
    """Best k vectors per query of ``block`` in each task of the scan, or in one of ``every`` tasks."""
    schema = _result_type(from_arrow_type(block.keys.type), query_id)
    dim = block.matrix.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % every:
            return
        best = Best(len(block.keys), k, _bars(block))
        for batch in batches:
            matrix, kept = vector_rows(batch.column("embedding"), dim)
            ids = batch.column("image_id").to_numpy(zero_copy_only=False)[kept]
            for which, rows in matcher(batch, kept) if matcher else [(None, None)]:
                _score(best, block, ids, matrix, which, rows)
        yield _found(block, best, schema)

    return vectors.select("image_id", "embedding", *carry).mapInArrow(scan, schema)


def slabs(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of some ``SLAB_ROWS`` rows at a time."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for batch in batches:
        matrix, kept = vector_rows(batch.column("embedding"), dim)
        waiting.append((batch.column("image_id").to_numpy(zero_copy_only=False)[kept], matrix))
        count += len(kept)
        if count >= SLAB_ROWS:
            yield tuple(np.concatenate(column) for column in zip(*waiting))
            waiting, count = [], 0
    if count:
        yield tuple(np.concatenate(column) for column in zip(*waiting))


def _walk_top(vectors: DataFrame, walk: Walk, keys: T.DataType, k: int, query_id: str, every: int = 1) -> DataFrame:
    """As :func:`scan_top`, for all blocks in one scan: each slab of vectors meets one block after the other.

    What a task remembers from slab to slab is one bar per query.
    """
    schema = _result_type(keys, query_id)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % every:
            return
        bars: dict[int, np.ndarray] = {}
        for ids, matrix in slabs(batches, walk.dim):
            for block in walk:
                best = Best(len(block.keys), k, bars.get(block.number, _bars(block)))
                _score(best, block, ids, matrix)
                yield _found(block, best, schema)
                bars[block.number] = best.bar

    return vectors.select("image_id", "embedding").mapInArrow(scan, schema)


def scan_all(vectors: DataFrame, blocks: Blocks, k: int, query_id: str, every: int = 1) -> DataFrame:
    """Of every task, or of one in ``every``, rows among which are its best k of each query."""
    if blocks.first is not None:
        return scan_top(vectors, next(iter(blocks)), k, query_id, every=every)
    return _walk_top(vectors, blocks.walk(), blocks.table.schema[blocks.key].dataType, k, query_id, every)


def with_bars(blocks: Blocks, vectors: DataFrame, k: int, query_id: str) -> Blocks:
    """``blocks`` with the k-th best score of each query in some splits of the corpus as ``bar``.

    With s splits searched out of n, about n / s times k rows per query pass the bars later on,
    and s times k are merged for them: s is the square root of n. Bars decide how many rows
    leave the scan, never which are the best, so an estimate of n is good enough.
    """
    splits = size.estimated_bytes(vectors) // max(size.SPLIT_BYTES, 1)
    if splits < LEAST_SPLITS:
        return blocks
    scored = scan_all(vectors, blocks, k, query_id, every=math.isqrt(splits))
    bars = merge_top(scored, k, query_id).where(F.col("rank") == k).select(F.col(query_id).alias(blocks.key), F.col("score").alias("bar"))
    return blocks.adding(materialize(bars, "bars"))


def merge_top(scored: DataFrame, k: int, query_id: str = "query_id") -> DataFrame:
    """Best k rows per query, ``rank`` from 1: score descending, then image_id.

    Unless there are few rows, slices of a query are cut to k before they meet.
    """
    best = [F.desc("score"), F.asc("image_id")]
    overall = Window.partitionBy(query_id).orderBy(*best)
    if is_small(scored, ONE_TASK_BYTES):
        return scored.withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= k)
    slices = scored.withColumn(
        "_slice", F.pmod(F.xxhash64("image_id"), F.lit(MERGE_SLICES)).cast("int")
    )
    in_slice = Window.partitionBy(query_id, "_slice").orderBy(*best)
    partial = (
        slices.withColumn("_place", F.row_number().over(in_slice))
        .where(F.col("_place") <= k)
        .drop("_place", "_slice")
    )
    return partial.withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= k)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def knn_exact(
    queries: DataFrame | Blocks,
    vectors: DataFrame,
    k: int,
    query_id: str = "query_id",
) -> DataFrame:
    """Exact k nearest ``vectors(image_id, embedding)`` of each of ``queries(query_id, embedding)``.

    Returns ``(query_id, image_id, score, rank)``. Vectors of another dimension
    than the queries, and NaN scores, match nothing.
    """
    blocks = with_bars(as_blocks(queries, query_id), vectors, k, query_id)
    return merge_top(scan_all(vectors, blocks, k, query_id), k, query_id)


def as_blocks(queries: DataFrame | Blocks, query_id: str = "query_id") -> Blocks:
    """Query vectors as blocks; a caller with several uses for them makes the blocks once."""
    return queries if isinstance(queries, Blocks) else matrix_blocks(queries, query_id, "embedding")


def score_pairs(
    pairs: DataFrame, queries: DataFrame, vectors: DataFrame, query_id: str = "query_id"
) -> DataFrame:
    """Cosine of given ``pairs(query_id, image_id)``: the exact scores of a candidate list.

    Neither a query with a third of all pairs nor an image in most of them ends
    up in one task.
    """
    asked = queries.select(query_id, F.col("embedding").alias("_query"))
    found = vectors.select("image_id", F.col("embedding").alias("_vector"))
    both = group_join(lookup_join(pairs, found, "image_id", "inner"), asked, [query_id], "image_id")
    return both.withColumn("score", score("_query", "_vector")).drop("_query", "_vector")
