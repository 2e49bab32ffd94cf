"""Approximate nearest neighbours over cells of vectors, with exact scores of what is looked at.

The vectors are stored by cell and a search reads only the cells next to its queries. Up to
``BLOCK_ROWS`` cells have a folder each, and tasks know all their centres. More cells are fitted on
two levels: vectors go to a group first and to a cell of that group then, so a task knows the centres
of the groups, or of the cells of one group; a folder holds a group, its files sorted by cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lumisift.functions.vectors import SCORE_DIGITS, noise_floor
from lumisift.operators.cutoff import Cutoff
from lumisift.operators.search import finish_search, searched
from lumisift.operators.topk import as_blocks, knn_exact, merge_top, scan_top, union_all
from lumisift.plans import blocks as block_sizes
from lumisift.plans.blocks import Block, Blocks, matrix_blocks, vector_rows
from lumisift.plans.running import dense_ids
from lumisift.plans.scratch import materialize
from lumisift.schema import small_table

CENTRES = T.StructType([
    T.StructField("cell", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

REPLACED = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("added", T.LongType())])

# Rows of one output file of a cell: 768 floats each make about 400 MB.
FILE_ROWS = 131_072
# Rows of a group that one task compares with the group's centres.
SLICE_ROWS = 65_536


@dataclass(frozen=True)
class StoredVectors:
    """Vectors under ``path`` in the order of some index, and the images that were added again."""

    spark: SparkSession
    path: str

    def vectors(self) -> DataFrame:
        """``(image_id, embedding, ...)``; of an image that was added again the newest only.

        Replaced vectors are left out by an anti join with their ids: build anew when those are many.
        """
        rows, again = self.rows(), self.replaced()
        if not again.isEmpty():
            newest = again.groupBy(F.col("image_id").alias("_image")).agg(F.max("added").alias("_newest"))
            old = (F.col("image_id") == F.col("_image")) & (F.col("added") < F.col("_newest"))
            rows = rows.join(newest, old, "left_anti")
        return rows.drop("added")

    def rows(self) -> DataFrame:
        """All that was ever stored; ``added`` counts the additions, from 0."""
        return self.spark.read.parquet(f"{self.path}/vectors")

    def replaced(self) -> DataFrame:
        return self.spark.read.schema(REPLACED).parquet(f"{self.path}/replaced")


def start_index(index: StoredVectors, vectors: DataFrame, write: Callable[[DataFrame, int], None]) -> None:
    small_table(index.spark, [], REPLACED).write.parquet(f"{index.path}/replaced")
    write(vectors, 0)


def add_to_index(index: StoredVectors, vectors: DataFrame, write: Callable[[DataFrame, int], None]) -> None:
    """Write ``vectors`` first and the ids that they replace after them, so that no image is ever without one."""
    number = index.rows().agg(F.coalesce(F.max("added"), F.lit(-1)) + 1).first()[0]
    write(vectors, number)
    older = index.rows().where(F.col("added") < number).select("image_id")
    again = older.join(vectors.select("image_id"), "image_id", "left_semi").distinct()
    again.withColumn("added", F.lit(number).cast("long")).write.mode("append").parquet(f"{index.path}/replaced")


def by_folder(rows: DataFrame, folder: list[str], path: str, order: list[str] | None = None) -> None:
    """Append ``rows`` in a folder per value of ``folder``, each written by as many tasks as its size asks for."""
    # At most one row per folder. The scan is repeated rather than stored: it does not shuffle.
    files = rows.groupBy(*folder).agg(F.ceil(F.count("*") / FILE_ROWS).alias("_files"))
    placed = rows.join(F.broadcast(files), folder).withColumn("_file", F.pmod(F.xxhash64("image_id"), F.col("_files")))
    placed = placed.repartition(*folder, "_file")
    if order:
        placed = placed.sortWithinPartitions(*folder, *order)
    placed.drop("_file", "_files").write.mode("append").partitionBy(*folder).parquet(path)


@dataclass(frozen=True)
class IvfIndex(StoredVectors):
    """Vectors by cell, and the cell centres."""

    def centres(self) -> DataFrame:
        """``(cell, embedding)``, and ``parent`` in an index on two levels."""
        return self.spark.read.parquet(f"{self.path}/centres")

    def parents(self) -> DataFrame:
        """``(cell, embedding)`` of the groups of cells."""
        return self.spark.read.schema(CENTRES).parquet(f"{self.path}/parents")

    def on_two_levels(self) -> bool:
        return "parent" in self.centres().columns


def _one_block(blocks: Blocks) -> Block:
    if blocks.first is None:
        raise ValueError(f"{blocks.rows} centres on one level: at most {block_sizes.BLOCK_ROWS}")
    return next(iter(blocks))


def _means(assigned: DataFrame, by: list[str]) -> DataFrame:
    """The unit mean of the vectors of each cell."""
    point = array_to_vector(F.col("embedding").cast("array<double>"))
    mean = assigned.groupBy(*by).agg(vector_to_array(Summarizer.mean(point)).alias("_mean"))
    norm = F.sqrt(F.aggregate("_mean", F.lit(0.0), lambda acc, x: acc + x * x))
    unit = F.transform("_mean", lambda x: (x / F.greatest(norm, F.lit(1e-6))).cast("float"))
    return mean.select(*by, unit.alias("embedding"))


def _in_order(vectors: DataFrame, seed: int) -> DataFrame:
    """The same vectors with a column to choose some of them by, as good as random and always the same."""
    return vectors.withColumn("_order", F.xxhash64(F.lit(seed), "image_id"))


def _to_fit_on(vectors: DataFrame, seed: int, fraction: float) -> DataFrame:
    """Stored vectors of the commonest length, a part of them if ``fraction`` is below 1."""
    vectors = vectors.select("image_id", "embedding")
    if fraction < 1.0:
        vectors = vectors.where(F.pmod(F.xxhash64(F.lit(seed + 1), "image_id"), F.lit(1_000_000)) < int(fraction * 1_000_000))
    dim = vectors.agg(F.mode(F.size("embedding"), deterministic=True)).first()[0]
    return materialize(vectors.where(F.size("embedding") == F.lit(dim)), "to-fit")


def fit_centres(
    vectors: DataFrame, cells: int, seed: int = 7, rounds: int = 10, fraction: float = 1.0
) -> DataFrame:
    """``(cell, embedding)``: unit centres of a k-means over the vectors, ``BLOCK_ROWS`` at most.

    ``fraction`` below 1 fits on a part of them. That moves the borders of the cells;
    every vector is still stored in some cell. Each round is one scan that sums the vectors of
    each cell; nothing is kept on executors in between. Cells that lose all vectors stay where they were.
    """
    if cells > block_sizes.BLOCK_ROWS:
        raise ValueError(f"{cells} centres on one level: at most {block_sizes.BLOCK_ROWS}")
    return _lloyd(_to_fit_on(vectors, seed, fraction), cells, seed, rounds)


def _lloyd(points: DataFrame, cells: int, seed: int, rounds: int) -> DataFrame:
    spark = points.sparkSession
    chosen = _in_order(points, seed).orderBy("_order", "image_id").limit(cells).select("embedding").collect()
    centres = {n: list(row["embedding"]) for n, row in enumerate(chosen)}

    def table() -> DataFrame:
        return small_table(spark, [{"cell": n, "embedding": e} for n, e in centres.items()], CENTRES)

    for _ in range(rounds):
        moved = {r["cell"]: r["embedding"] for r in _means(assign_cells(points, table()), ["cell"]).collect()}
        if all(moved.get(n, e) == e for n, e in centres.items()):
            break
        centres |= moved
    return table()


def fit_two_levels(
    vectors: DataFrame, cells: int, seed: int = 7, rounds: int = 10, fraction: float = 1.0, inner_rounds: int = 3
) -> tuple[DataFrame, DataFrame]:
    """About ``cells`` centres ``(cell, parent, embedding)`` and their groups ``(cell, embedding)``.

    There are about as many groups as cells in a group. A group gets cells by its share of the vectors. The
    centres of all cells are a table throughout and never meet in the driver or in one task; their
    ``inner_rounds`` shuffle the vectors that are fitted on.
    """
    groups = min(block_sizes.BLOCK_ROWS, max(1, int(cells**0.5)))
    points = _to_fit_on(vectors, seed, fraction)
    parents = materialize(_lloyd(points, groups, seed, rounds), "parents")
    grouped = assign_cells(points, parents).withColumnRenamed("cell", "parent")
    grouped = materialize(_in_order(grouped, seed), "grouped")
    share = grouped.groupBy("parent").agg(F.count("*").alias("_n"))
    total = max(grouped.count(), 1)
    share = materialize(share.withColumn("_cells", F.least(
        F.lit(block_sizes.BLOCK_ROWS), F.ceil(F.col("_n") * cells / F.lit(float(total)))).cast("int")), "shares")
    place = F.expr("row_number() OVER (PARTITION BY parent ORDER BY _order, image_id)")
    first = grouped.withColumn("_place", place).where(F.col("_place") <= block_sizes.BLOCK_ROWS).join(
        F.broadcast(share), "parent").where(F.col("_place") <= F.col("_cells"))
    key = F.format_string("%010d %010d", "parent", "_place")
    numbered = dense_ids(first.select("parent", "embedding", key.alias("_key")), "_key", start=0, name="cell")
    centres = materialize(numbered.select(F.col("cell").cast("int"), "parent", "embedding"), "centres")
    for _ in range(inner_rounds):
        moved = _means(assign_in_groups(grouped.select("image_id", "embedding", "parent"), centres), ["cell", "parent"])
        kept = centres.join(moved.select("cell"), "cell", "left_anti").select("cell", "parent", "embedding")
        centres = materialize(moved.select("cell", "parent", "embedding").unionByName(kept), "centres")
    # A group that none of the fitted vectors is in has no cells to offer to others.
    used = centres.select(F.col("parent").alias("cell")).distinct()
    return centres, parents.join(used, "cell", "left_semi")


def assign_cells(vectors: DataFrame, centres: DataFrame | Block) -> DataFrame:
    """Add ``cell``, the centre with the highest dot product; the lowest number wins a tie."""
    block = centres if isinstance(centres, Block) else _one_block(
        matrix_blocks(centres, "cell", "embedding"))
    dim = block.matrix.shape[1]
    schema = T.StructType(
        [*vectors.schema.fields, T.StructField("cell", T.IntegerType())]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, kept = vector_rows(batch.column("embedding"), dim)
            cell = _nearest(points, block.matrix, block.keys.to_numpy())
            fitting = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*fitting.columns, pa.array(cell)], names=schema.fieldNames())

    return vectors.mapInArrow(assign, schema)


def _nearest(points: np.ndarray, matrix: np.ndarray, names: np.ndarray) -> np.ndarray:
    scores = np.round(points @ matrix.T, SCORE_DIGITS)
    return names[np.argmax(scores, axis=1)].astype(np.int32)


def assign_in_groups(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """Add ``cell`` to ``vectors(..., embedding, parent)``: the nearest centre of their ``parent``.

    A group is cut into slices, so a task holds ``SLICE_ROWS`` vectors or so and the centres of one group.
    """
    sizes = vectors.groupBy("parent").agg(F.ceil(F.count("*") / F.lit(float(SLICE_ROWS))).cast("int").alias("_slices"))
    cut = vectors.join(F.broadcast(sizes), "parent").withColumn(
        "_slice", F.pmod(F.xxhash64("image_id"), F.col("_slices")).cast("int")).drop("_slices")
    copies = centres.join(F.broadcast(sizes), "parent").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])
    names = vectors.columns

    def assign(rows: pa.Table, near: pa.Table) -> pa.Table:
        near = near.sort_by("cell")
        dim = len(near.column("embedding")[0]) if near.num_rows else 0
        matrix, there = vector_rows(near.column("embedding"), dim)
        points, kept = vector_rows(rows.column("embedding"), dim)
        rows = rows.select(names).take(pa.array(kept))
        if not rows.num_rows or not near.num_rows:
            return rows.slice(0, 0).append_column("cell", pa.array([], pa.int32()))
        cell = _nearest(points, matrix, near.column("cell").to_numpy()[there])
        return rows.append_column("cell", pa.array(cell))

    return cut.groupBy("parent", "_slice").cogroup(copies.groupBy("parent", "_slice")).applyInArrow(assign, schema)


def ivf_build(
    vectors: DataFrame,
    path: str,
    cells: int = 64,
    centres: DataFrame | None = None,
    seed: int = 7,
    fraction: float = 1.0,
    level: int | None = None,
) -> IvfIndex:
    """Store ``vectors(image_id, embedding)`` by cell under ``path``.

    Without ``centres(cell, embedding)`` they are fitted, on a ``fraction`` of the vectors, and more
    than ``level`` of them (``BLOCK_ROWS``, which is the most) on two levels. A cell is written by as many tasks as its size asks for,
    so a cell with a third of all rows neither fills one task nor one file.
    """
    index, spark = IvfIndex(vectors.sparkSession, path), vectors.sparkSession
    if centres is None and cells > min(level or block_sizes.BLOCK_ROWS, block_sizes.BLOCK_ROWS):
        centres, parents = fit_two_levels(vectors, cells, seed, fraction=fraction)
        parents.write.parquet(f"{path}/parents")
        centres.write.parquet(f"{path}/centres")
    else:
        centres = fit_centres(vectors, cells, seed, fraction=fraction) if centres is None else centres
        small_table(spark, [], CENTRES).write.parquet(f"{path}/parents")
        centres.select(F.col("cell").cast("int"), F.col("embedding").cast("array<float>")).write.parquet(f"{path}/centres")
    start_index(index, vectors, lambda rows, number: _write_cells(index, rows, number))
    return index


def ivf_add(index: IvfIndex, vectors: DataFrame) -> IvfIndex:
    """Add ``vectors(image_id, embedding)``; one whose image the index holds replaces the older.

    If a run dies in between, adding the same again puts it right.
    """
    add_to_index(index, vectors, lambda rows, number: _write_cells(index, rows, number))
    return index


def _write_cells(index: IvfIndex, vectors: DataFrame, number: int) -> None:
    vectors = vectors.select("image_id", "embedding")
    added = F.lit(number).cast("long").alias("added")
    if index.on_two_levels():
        grouped = assign_cells(vectors, index.parents()).withColumnRenamed("cell", "parent")
        assigned = materialize(assign_in_groups(grouped, index.centres()), "assigned")
        by_folder(assigned.select("*", added), ["parent"], f"{index.path}/vectors", ["cell"])
    else:
        by_folder(assign_cells(vectors, index.centres()).select("*", added), ["cell"], f"{index.path}/vectors")


def _asked_cells(block: Block, index: IvfIndex, nprobe: int, centres: Block | None) -> tuple[dict[int, np.ndarray], list[int]]:
    """Which queries of ``block`` look into a cell, by cell, and the groups of those cells."""
    if centres is not None:
        names = centres.keys.to_numpy()
        scores = np.round(block.matrix @ centres.matrix.T, SCORE_DIGITS)
        order = names[np.argsort(-scores, axis=1, kind="stable")[:, :nprobe]]
        return {int(c): np.flatnonzero((order == c).any(axis=1)) for c in np.unique(order)}, []
    queries = index.spark.createDataFrame(
        pa.table({"query_id": pa.array(range(len(block.keys)), pa.int64()), "embedding": pa.array(list(block.matrix))}))
    rows = index.centres()
    near = knn_exact(queries, rows.select(F.col("cell").cast("long").alias("image_id"), "embedding"), nprobe)
    near = near.select("query_id", F.col("image_id").cast("int").alias("cell")).join(rows.select("cell", "parent"), "cell").toArrow()
    query, cell = near.column("query_id").to_numpy(), near.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    found = np.unique(cell)
    starts = np.searchsorted(cell[order], found)
    asked = {int(c): np.sort(q) for c, q in zip(found, np.split(query[order], starts[1:]))}
    return asked, [int(p) for p in np.unique(near.column("parent").to_numpy())]


def knn_ivf(
    queries: DataFrame | Blocks, index: IvfIndex, k: int, nprobe: int, query_id: str = "query_id"
) -> DataFrame:
    """Top k among the ``nprobe`` cells nearest to each query. All cells give the exact result."""
    two = index.on_two_levels()
    centres = None if two else _one_block(matrix_blocks(index.centres(), "cell", "embedding"))
    vectors = index.vectors()
    scans = []
    for block in as_blocks(queries, query_id):
        asked, groups = _asked_cells(block, index, nprobe, centres)
        near = vectors.where(F.col("cell").isin(list(asked)))
        if two:
            near = near.where(F.col("parent").isin(groups))
        scans.append(scan_top(near, block, k, query_id, _by_cell(asked), ("cell",)))
    return merge_top(union_all(scans), k, query_id)


def search_ivf(
    queries: DataFrame | Blocks,
    index: IvfIndex,
    manifest: DataFrame,
    directory: str,
    nprobe: int,
    limit: int = 0,
    cutoff: Cutoff = "auto",
    sigmas: float = 3.0,
    query_id: str = "query_id",
    pool: int | None = None,
) -> DataFrame:
    """:func:`lumisift.operators.search.search` with pools from the cells near each query."""
    blocks = as_blocks(queries, query_id)
    pool = searched(cutoff, limit, pool)
    hits = knn_ivf(blocks, index, pool, nprobe, query_id)
    floor = noise_floor(max(blocks.dim, 1), sigmas)
    return finish_search(
        hits, manifest, directory, limit, cutoff, floor, query_id, most=blocks.rows * pool)


def _by_cell(asked: dict[int, np.ndarray]):
    def match(batch: pa.RecordBatch, kept: np.ndarray):
        cell = batch.column("cell").to_numpy(zero_copy_only=False)[kept]
        for name in np.unique(cell):
            yield asked[int(name)], np.flatnonzero(cell == name)

    return match


def recall_at_k(found: DataFrame, exact: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Share of the exact neighbours that were found, over all queries."""
    hit = found.select(query_id, "image_id", F.lit(1).alias("_hit"))
    return exact.join(hit, [query_id, "image_id"], "left").agg(
        F.count("*").alias("expected"),
        F.count("_hit").alias("found"),
        (F.count("_hit") / F.count("*")).alias("recall"),
    )
