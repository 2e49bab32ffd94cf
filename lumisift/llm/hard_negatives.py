"""Hard negatives: rows of another label whose score with an anchor lies in a window below a positive's.

Scores are exact integers from float32 matrix products (``residue_gemm``). Anchors, a stated share of all rows, are
compared with every row in cells: rows are dealt into slabs and anchors into blocks, each slab is sent to each block
once, and a cell of the two is one bounded task. It puts out no pair of rows, only the best of each anchor and
window, which a ranking over all cells then cuts to the asked number. One round of cells finds the positives, a second
the negatives in the windows that the positives open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumisift.llm.residue_gemm import ResidueMatrix, primes_for
from lumisift.plans.scratch import materialize

ANCHOR_BLOCK = 4096
# Rows of a slab: enough slabs for all cores on small tables, few candidates per anchor on large ones.
LEAST_SLAB, LARGEST_SLAB, SLABS = 8192, 262_144, 64
# Scores that one step of a cell holds.
SCORES = 2**21

_POSITIVES = "anchor_id long, positive_id long, positive_score long"
_NEGATIVES = _POSITIVES + ", negative_id long, negative_score long"


def usable_rows(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """``(vec_id, label, embedding, size)`` of the rows of ``df`` with an id, a label and finite components throughout.

    ``size`` is the sum of squares of the scaled, floored components.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    floored = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    return rows.withColumn("size", F.aggregate(floored, F.lit(0.0), lambda acc, x: acc + x * x))


def _slab_of(rows: DataFrame, slabs: int, blocks: int) -> DataFrame:
    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(slabs)).cast("int")
    return rows.select("vec_id", "label", "embedding", place.alias("slab")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))


def _block_of(anchors: DataFrame, slabs: int, blocks: int) -> DataFrame:
    place = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    return anchors.withColumn("block", place).select("*", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"))


class _Rows:
    """Rows of one side of a cell, by label and id, repeated rows once."""

    def __init__(self, table: pa.Table, scale: float, dim: int, primes: list[int]):
        vectors = table.column("embedding").combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
        matrix = np.zeros((len(sizes), dim), np.int64)
        # Shorter vectors are as if filled up with zeros.
        matrix[np.arange(dim) < sizes[:, None]] = flat
        ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        order = np.lexsort((ids, labels))
        ids, labels, matrix = ids[order], labels[order], matrix[order]
        if len(ids) > len(np.unique(ids)):
            _, first = np.unique(np.column_stack([labels, ids, matrix]), axis=0, return_index=True)
            first.sort()
            ids, labels, matrix, order = ids[first], labels[first], matrix[first], order[first]
        self.ids, self.labels, self.order = ids, labels, order
        self.matrix = ResidueMatrix(matrix, primes)

    def __len__(self) -> int:
        return len(self.ids)

    def of(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))


def _best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` highest scores, equal ones by id."""
    there = np.arange(len(scores))
    if len(scores) > count:
        there = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
    return there[np.lexsort((ids[there], -scores[there]))][:count]


def _steps(anchors: _Rows, rows: int) -> Iterator[tuple[int, int]]:
    step = max(1, SCORES // max(1, rows))
    for low in range(0, len(anchors), step):
        yield low, min(low + step, len(anchors))


def _positives_of(count: int, read: Callable) -> Callable:
    def cell(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, some = read(rows), read(anchors)
        out: list[np.ndarray] = []
        for label in np.unique(some.labels):
            low, high = rows.of(label)
            same, ids = rows.matrix.rows(low, high), rows.ids[low:high]
            first, last = some.of(label)
            for a, b in ((a, b) for a, b in _steps(some, high - low) if a < last and b > first):
                a, b = max(a, first), min(b, last)
                scores = some.matrix.rows(a, b).scores(same)
                for anchor, values in zip(some.ids[a:b], scores):
                    others = np.flatnonzero(ids != anchor)
                    best = others[_best(values[others], ids[others], count)]
                    out.append(np.column_stack([np.full(len(best), anchor), ids[best], values[best]]))
        return _table(out, ("anchor_id", "positive_id", "positive_score"))

    return cell


def _negatives_of(count: int, window: tuple[int, int], read: Callable) -> Callable:
    def cell(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, some = read(rows), read(anchors)
        given = anchors.column("positives").combine_chunks().take(pa.array(some.order))
        out: list[np.ndarray] = []
        for a, b in _steps(some, len(rows)):
            scores = some.matrix.rows(a, b).scores(rows.matrix)
            for at, values in zip(range(a, b), scores):
                positives = [(p["positive_id"], p["positive_score"]) for p in given[at].as_py()]
                # Whole scores with low * positive <= 100 * score <= high * positive.
                bounds = [(-(-window[0] * s // 100), window[1] * s // 100) for _, s in positives]
                fits = (values >= min(b[0] for b in bounds)) & (values <= max(b[1] for b in bounds))
                fits[slice(*rows.of(some.labels[at]))] = False
                near = np.flatnonzero(fits)
                near_scores, near_ids = values[near], rows.ids[near]
                for (positive, score), (low, high) in zip(positives, bounds):
                    inside = np.flatnonzero((near_scores >= low) & (near_scores <= high))
                    best = inside[_best(near_scores[inside], near_ids[inside], count)]
                    same = np.full((len(best), 3), (some.ids[at], positive, score))
                    out.append(np.column_stack([same, near_ids[best], near_scores[best]]))
        return _table(out, ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))

    return cell


def _table(parts: list[np.ndarray], names: tuple[str, ...]) -> pa.Table:
    whole = np.concatenate([np.zeros((0, len(names)), np.int64), *parts])
    return pa.table({name: whole[:, n] for n, name in enumerate(names)})


def _first(df: DataFrame, by: str, order: str, count: int) -> DataFrame:
    """The first ``count`` different rows of each group, with their ``rank``."""
    ranked = df.selectExpr("*", f"dense_rank() OVER (PARTITION BY {by} ORDER BY {order}) AS rank")
    return ranked.where(F.col("rank") <= count).distinct()


def mine_hard_negatives(
    df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10,
    window: tuple[int, int] = (30, 90), scale: float = 256.0,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``df`` ``(vec_id, embedding, label)``.

    Each component counts as ``floor(scale * x)``, a score is the inner product of two rows, and equal scores go by
    ``vec_id``. An anchor (a row for which the condition ``anchors`` on ``vec_id`` and ``label`` holds) has as positives its
    ``positives`` best other rows of the same label; for each of them the ``negatives`` best rows of other labels are
    returned whose score is from ``window[0]`` to ``window[1]`` percent of the positive's, ranked from 1.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Shorter vectors are filled
    up with zeros. A row that repeats another one counts once; of rows that share an anchor's id the one with the
    least label, then vector, is the anchor, and none of them its positive. Other columns are ignored. No rows, no
    anchors, no positives or an empty window give no rows. Scores must fit a long: components too large for that raise
    an ``ArithmeticError``.
    """
    rows = usable_rows(df, scale)
    chosen = rows.where(anchors)
    facts = rows.agg(
        F.count("*").alias("n"), F.count(F.when(anchors, 1)).alias("anchors"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"), F.coalesce(F.max("size"), F.lit(0.0)).alias("size")).first()
    if not facts["size"] < 2.0**62:
        raise ArithmeticError("scores of these components do not fit a long")
    primes, dim = primes_for(int(facts["size"] * (1 + 1e-9)) + 1), facts["dim"]
    slab = min(LARGEST_SLAB, max(LEAST_SLAB, facts["n"] // SLABS))
    slabs, blocks = max(1, -(-facts["n"] // slab)), max(1, -(-facts["anchors"] // ANCHOR_BLOCK))

    def read(table: pa.Table) -> _Rows:
        return _Rows(table, scale, dim, primes)

    once = chosen.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("a")).select("vec_id", "a.label", "a.embedding")
    once = materialize(once, "anchors")

    def cells(asking: DataFrame, run: Callable, schema: str) -> DataFrame:
        dealt = _slab_of(rows, slabs, blocks).groupBy("slab", "block")
        return dealt.cogroup(_block_of(asking, slabs, blocks).groupBy("slab", "block")).applyInArrow(run, schema)

    found = cells(once, _positives_of(positives, read), _POSITIVES)
    found = materialize(_first(found, "anchor_id", "positive_score DESC, positive_id", positives).drop("rank"), "positives")
    listed = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    mined = cells(once.join(listed, "vec_id"), _negatives_of(negatives, window, read), _NEGATIVES)
    return _first(mined, "anchor_id, positive_id, positive_score", "negative_score DESC, negative_id", negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
