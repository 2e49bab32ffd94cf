"""Approximate nearest neighbours by buckets of random projections, with exact scores of what is looked at.

In each of a few tables a vector falls into the bucket that its projections on some random directions have in
common, cut to steps. The vectors stand once per table, in folders of buckets, sorted by bucket, so a search reads
the files of the buckets that it asks for and no others. A query asks for its own bucket and for those next to
it, nearest first: the cost of a step to a neighbour is how far the query lies from the border between them. A
vector that shares buckets with a query in several tables is scored in the first of these alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumisift.operators.ann import StoredVectors, add_to_index, by_folder, start_index
from lumisift.operators.topk import Matcher, as_blocks, merge_top, scan_top, union_all
from lumisift.plans.blocks import Block, Blocks, vector_rows
from lumisift.schema import small_table

# Folders of buckets in each table, at most, and how many vectors make up for one.
FOLDERS = 64
FOLDER_ROWS = 65_536
# Neighbouring buckets that are put in order for a query and table.
NEIGHBOURS = 4096
_MIX = 1_000_003

HASHES = T.StructType([
    T.StructField("table", T.IntegerType()), T.StructField("place", T.IntegerType()),
    T.StructField("shift", T.DoubleType()), T.StructField("step", T.DoubleType()),
    T.StructField("direction", T.ArrayType(T.DoubleType())), T.StructField("folders", T.IntegerType()),
])


@dataclass(frozen=True)
class Hashes:
    """Directions of all tables side by side, the shifts along them, the step, and the folders of a table."""

    tables: int
    folders: int
    directions: np.ndarray
    shifts: np.ndarray
    step: float

    def places(self, points: np.ndarray) -> np.ndarray:
        """Place on every direction in steps, ``[point, table, direction]``."""
        return ((points @ self.directions + self.shifts) / self.step).reshape(len(points), self.tables, self.directions.shape[1] // self.tables)

    @staticmethod
    def buckets(steps: np.ndarray) -> np.ndarray:
        """One number for the whole steps on the last axis."""
        number = np.zeros(steps.shape[:-1], np.int64)
        for place in range(steps.shape[-1]):
            number = number * _MIX + steps[..., place].astype(np.int64)
        return number

    def probes(self, points: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest buckets of each point, ``[point, table, probe]``."""
        places = self.places(points)
        whole = np.floor(places)
        inside = places - whole
        directions = places.shape[2]
        reach = max(1, int((NEIGHBOURS ** (1 / directions) - 1) // 2 + 1e-9))
        moves = np.array(list(itertools.product(range(-reach, reach + 1), repeat=directions)))
        cost = np.zeros((*places.shape[:2], len(moves)))
        for d in range(directions):
            move, at = moves[:, d], inside[:, :, d, None]
            cost += np.where(move < 0, at - move - 1, np.where(move > 0, move - at, 0.0)) ** 2
        nearest = np.argsort(cost, axis=2, kind="stable")[:, :, :count]
        return self.buckets(whole[:, :, None, :] + moves[nearest])


@dataclass(frozen=True)
class LshIndex(StoredVectors):
    """Vectors by table and bucket, and the hash functions."""

    def hashes(self) -> Hashes:
        rows = self.spark.read.schema(HASHES).parquet(f"{self.path}/hashes").orderBy("table", "place").collect()
        directions = np.array([r["direction"] for r in rows]).T
        return Hashes(rows[-1]["table"] + 1, rows[0]["folders"], directions, np.array([r["shift"] for r in rows]), rows[0]["step"])


def lsh_build(
    vectors: DataFrame, path: str, tables: int = 4, planes: int = 6, width: float = 2.0, seed: int = 7,
    folders: int | None = None,
) -> LshIndex:
    """Store ``vectors(image_id, embedding)`` by bucket under ``path``, once for each of ``tables``.

    A bucket is what ``planes`` directions agree on, in steps of ``width`` times the spread that unit vectors have
    on a random direction. More planes make smaller buckets. Vectors whose length is not the commonest are left out.
    A table gets ``folders``, by default one for 65,536 vectors and 64 at most; a folder is written by as many tasks
    as its size asks for.
    """
    spark = vectors.sparkSession
    dim, count = vectors.agg(F.mode(F.size("embedding"), deterministic=True), F.count("*")).first()
    dim = dim or 1
    folders = folders or max(1, min(FOLDERS, count // FOLDER_ROWS))
    draw = np.random.default_rng(seed)
    directions = draw.normal(size=(tables * planes, dim))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    step = width / dim**0.5
    small_table(spark, [
        {"table": n // planes, "place": n % planes, "shift": float(draw.uniform(0, step)), "step": step,
         "direction": d.tolist(), "folders": folders}
        for n, d in enumerate(directions)], HASHES).write.parquet(f"{path}/hashes")
    index = LshIndex(spark, path)
    start_index(index, vectors, lambda rows, number: _write(index, rows, number))
    return index


def lsh_add(index: LshIndex, vectors: DataFrame) -> LshIndex:
    """Add ``vectors(image_id, embedding)``; one whose image the index holds replaces the older."""
    add_to_index(index, vectors, lambda rows, number: _write(index, rows, number))
    return index


def _write(index: LshIndex, vectors: DataFrame, number: int) -> None:
    hashes = index.hashes()
    dim = len(hashes.directions)
    plain = vectors.select(F.col("image_id").cast("long"), F.col("embedding").cast("array<float>"))
    schema = T.StructType([*plain.schema.fields, T.StructField("buckets", T.ArrayType(T.LongType()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, kept = vector_rows(batch.column("embedding"), dim)
            buckets = hashes.buckets(np.floor(hashes.places(points)))
            offsets = pa.array(np.arange(0, buckets.size + 1, hashes.tables), pa.int32())
            column = pa.ListArray.from_arrays(offsets, pa.array(buckets.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, column], names=schema.fieldNames())

    posted = plain.mapInArrow(hashed, schema).select(
        "*", F.posexplode("buckets").alias("table", "bucket"), F.lit(number).cast("long").alias("added"))
    posted = posted.withColumn("folder", F.pmod("bucket", F.lit(hashes.folders)).cast("int"))
    by_folder(posted, ["table", "folder"], f"{index.path}/vectors", ["bucket"])


def knn_lsh(
    queries: DataFrame | Blocks, index: LshIndex, k: int, probes: int = 64, query_id: str = "query_id"
) -> DataFrame:
    """Top k among the vectors in the ``probes`` nearest buckets of each query in each table.

    A bucket is never gathered: each task scores the rows it reads, so a bucket with a third of all rows is
    spread over as many tasks as it has splits. Queries of another length match nothing.
    """
    hashes = index.hashes()
    vectors = index.vectors()
    scans = []
    for block in as_blocks(queries, query_id):
        if block.matrix.shape[1] != len(hashes.directions):
            block = Block(block.keys.slice(0, 0), np.zeros((0, len(hashes.directions))), {})
        asked = hashes.probes(block.matrix, probes)
        near = vectors.where(_standing_in(asked, hashes.folders))
        scans.append(scan_top(near, block, k, query_id, _in_first_table(asked), ("table", "buckets")))
    return merge_top(union_all(scans), k, query_id)


def _standing_in(asked: np.ndarray, folders: int) -> Column:
    """The folders and buckets of the asked tables, for the scan to prune by."""
    if not asked.size:
        return F.lit(False)

    def among(values: np.ndarray) -> str:
        return ", ".join(map(str, np.unique(values).tolist()))

    places = " OR ".join(
        f"(table = {t} AND folder IN ({among(asked[:, t] % folders)}))" for t in range(asked.shape[1]))
    return F.expr(f"({places}) AND bucket IN ({among(asked)})")


def _in_first_table(asked: np.ndarray) -> Matcher:
    """Queries and rows that share a bucket in the row's table and in no table before it."""
    queries, tables, _ = asked.shape

    def match(batch: pa.RecordBatch, kept: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        table = batch.column("table").to_numpy(zero_copy_only=False)[kept]
        column = batch.column("buckets").take(pa.array(kept))
        buckets = column.flatten().to_numpy(zero_copy_only=False).reshape(len(kept), tables)
        for t in np.unique(table):
            rows = np.flatnonzero(table == t)
            rows = rows[np.argsort(buckets[rows, t], kind="stable")]
            own = buckets[rows, t]
            starts, ends = np.searchsorted(own, asked[:, t]), np.searchsorted(own, asked[:, t], side="right")
            for query in np.flatnonzero((ends > starts).any(axis=1)):
                here = np.concatenate([rows[a:b] for a, b in zip(starts[query], ends[query]) if b > a])
                for earlier in range(t):
                    here = here[~np.isin(buckets[here, earlier], asked[query, earlier])]
                if len(here):
                    yield np.array([query]), here

    return match
