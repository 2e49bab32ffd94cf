"""Small matrices as parameters of a job, and large ones as files that tasks walk through.

Query vectors, cluster centres and projection weights are needed by the tasks that scan the
corpus. One block holds at most ``BLOCK_ROWS`` vectors (25 MB of doubles at 768 dimensions). A
single block goes out with the tasks. A table with more rows is packed into files in the shared
folder, one row per block; Spark hands the files to the executors, and a task reads one block
after the other, so neither a task nor the driver ever holds them all.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F, types as T

from lumisift.plans.running import dense_ids
from lumisift.plans.scratch import materialize

BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Block:
    """Some rows of a keyed matrix: ``keys[i]`` belongs to ``matrix[i]``; ``number`` tells blocks apart."""

    keys: pa.Array
    matrix: np.ndarray
    extra: dict[str, np.ndarray]
    number: int = 0


def _block(table: pa.Table, key: str, vector: str, dim: int, number: int = 0) -> Block:
    table = table.sort_by(key)
    matrix, kept = vector_rows(table.column(vector), dim)
    table = table.take(pa.array(kept))
    extra = {name: _values(table.column(name)) for name in table.column_names if name not in (key, vector)}
    return Block(table.column(key).combine_chunks(), matrix, extra, number)


def _values(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    if not pa.types.is_list(column.type):
        return np.array(values)
    # Lists may differ in length.
    out = np.empty(len(values), object)
    for place, value in enumerate(values):
        out[place] = np.array(value)
    return out


@dataclass(frozen=True)
class Walk:
    """The blocks as a task sees them, one at a time."""

    key: str
    vector: str
    dim: int
    only: Block | None
    files: tuple[str, ...]

    def __iter__(self) -> Iterator[Block]:
        if self.only is not None:
            yield self.only
        for name in self.files:
            with pq.ParquetFile(SparkFiles.get(name)) as file:
                for batch in file.iter_batches(batch_size=1):
                    rows = pa.Table.from_struct_array(batch.column("rows")[0].values)
                    yield _block(rows, self.key, self.vector, self.dim, batch.column("block")[0].as_py())


@dataclass(frozen=True)
class Blocks:
    """A keyed matrix; ``rows`` counts those of other lengths as well, which match nothing."""

    rows: int
    dim: int
    first: pa.Table | None
    table: DataFrame
    key: str
    vector: str

    def __iter__(self) -> Iterator[Block]:
        """The blocks, read from their table one at a time, in the driver."""
        if self.first is not None:
            yield self._of(self.first)
            return
        for number in range(-(-self.rows // BLOCK_ROWS)):
            yield self._of(self.table.where(F.col("_block") == number).drop("_block").toArrow())

    def _of(self, table: pa.Table) -> Block:
        return _block(table, self.key, self.vector, self.dim)

    def walk(self) -> Walk:
        """The blocks for the tasks of a scan."""
        if self.first is not None:
            return Walk(self.key, self.vector, self.dim, self._of(self.first), ())
        packed = self.table.groupBy("_block").agg(
            F.collect_list(F.struct(*[c for c in self.table.columns if c != "_block"])).alias("rows"))
        files = materialize(packed.withColumnRenamed("_block", "block"), "blocks").inputFiles()
        for file in files:
            self.table.sparkSession.sparkContext.addFile(file)
        return Walk(self.key, self.vector, self.dim, None, tuple(os.path.basename(f) for f in files))

    def adding(self, values: DataFrame) -> Blocks:
        """The same rows with the other columns of ``values``, unique on the key, in ``extra``; null where it has none."""
        joined = self.table.join(values, self.key, "left")
        if self.first is not None:
            return Blocks(self.rows, self.dim, joined.toArrow(), joined, self.key, self.vector)
        return Blocks(self.rows, self.dim, None, materialize(joined, "blocks"), self.key, self.vector)


def matrix_blocks(
    df: DataFrame, key: str, vector: str, dim: int | None = None, extra: tuple[str, ...] = ()
) -> Blocks:
    """Blocks of ``df`` in order of the unique ``key``.

    ``dim`` defaults to the commonest dimension, the smallest of several; rows of another
    dimension are left out. ``df`` is computed more than once: store it first when that is costly.
    """
    wanted = df.select(key, vector, *extra)
    head = wanted.limit(BLOCK_ROWS + 1).toArrow()
    whole = head.num_rows <= BLOCK_ROWS
    if dim is None and whole:
        lengths = pc.list_value_length(head.column(vector)).drop_null().to_numpy()
        dim = int(np.argmax(np.bincount(lengths))) if len(lengths) else 0
    elif dim is None:
        dim = wanted.agg(F.mode(F.when(F.col(vector).isNotNull(), F.size(vector)), deterministic=True)).first()[0] or 0
    if whole:
        return Blocks(head.num_rows, dim, head, df.sparkSession.createDataFrame(head, wanted.schema), key, vector)
    numbered = dense_ids(wanted, key, start=0, name="_row")
    table = materialize(numbered.withColumn("_block", F.expr(f"CAST(_row DIV {BLOCK_ROWS} AS INT)")).drop("_row"), "queries")
    return Blocks(table.count(), dim, None, table, key, vector)


def vector_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of the entries with ``dim`` numbers, and which entries those are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    fits = lengths == dim
    if not fits.all():
        column = column.filter(pa.array(fits))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), dim), np.flatnonzero(fits)
