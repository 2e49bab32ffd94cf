"""Numeric reductions and products: centroids, softmax, projection, row lookup, run statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumisift.functions.vectors import l2_normalize
from lumisift.plans.blocks import Block, matrix_blocks, vector_rows
from lumisift.plans.skew import group_join, lookup_join


def mean_pool(df: DataFrame, by: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Element-wise mean of the vectors of each group.

    One aggregate over whole vectors: map tasks send one partial sum per group,
    and no vector is exploded.
    """
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.groupBy(*by).agg(vector_to_array(mean).alias(vector))


def centroids(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Unit mean vector per group."""
    return mean_pool(df, [by], vector).withColumn(vector, l2_normalize(vector))


def softmax_scores(
    df: DataFrame, by: str, score: str = "score", out: str = "weight", spread: str = "image_id"
) -> DataFrame:
    """Softmax of the scores of each group, shifted by the group's maximum.

    Two aggregates with partial sums, and joins that cut a group into slices by
    ``spread``; no group meets in one task.
    """
    tops = df.groupBy(by).agg(F.max(score).alias("_top"))
    power = F.exp(F.col(score) - F.col("_top"))
    sums = group_join(df, tops, [by], spread).groupBy(by).agg(
        F.first("_top").alias("_top"), F.sum(power).alias("_sum")
    )
    return group_join(df, sums, [by], spread).withColumn(out, power / F.col("_sum")).drop("_top", "_sum")


def linear_project(
    df: DataFrame,
    weights: DataFrame,
    alpha: float = 1.0,
    beta: float = 1.0,
    key: str = "image_id",
    vector: str = "embedding",
    out: str = "projected",
) -> DataFrame:
    """``alpha * v.W + beta * b`` per row, as an array with one number per column of W.

    ``weights(col, w, b)`` holds the columns of W with their bias. W is shipped to
    the tasks in bounded blocks of columns; the parts of a row are put together
    only when there is more than one block.
    """
    blocks = matrix_blocks(weights, "col", "w", extra=("b",))
    parts = [
        _project(df, block, alpha, beta, key, vector, out).withColumn("_block", F.lit(i))
        for i, block in enumerate(blocks)
    ]
    if len(parts) == 1:
        return parts[0].drop("_block")
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    ordered = F.array_sort(F.collect_list(F.struct("_block", out)))
    return joined.groupBy(key).agg(F.flatten(F.transform(ordered, lambda p: p[out])).alias(out))


def _project(
    df: DataFrame, block: Block, alpha: float, beta: float, key: str, vector: str, out: str
) -> DataFrame:
    weights = block.matrix.T * alpha
    bias = block.extra["b"].astype(np.float64) * beta
    dim, width = weights.shape
    schema = T.StructType([df.schema[key], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, kept = vector_rows(batch.column(vector), dim)
            values = (matrix @ weights + bias).ravel()
            offsets = np.arange(len(kept) + 1, dtype=np.int32) * width
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(kept)), rows],
                                             names=[key, out])

    return df.select(key, vector).mapInArrow(project, schema)


def embedding_lookup(
    df: DataFrame, table: DataFrame, key: str = "key", ids: str = "ids", index: str = "idx",
    vector: str = "embedding",
) -> DataFrame:
    """Rows of ``table(idx, embedding)``, in order, for each ordered id list of ``df(key, ids)``.

    ``idx`` counts from 0 without gaps; a negative id counts from the end. An id
    outside the table gives a null entry. An empty or null list gives an empty one. An id that fills most lists, such as
    padding, is looked up where it lies.
    """
    size = table.agg(F.count("*")).scalar()
    asked = df.select(key, F.posexplode_outer(ids).alias("_pos", "_id")).select(
        key, "_pos", F.when(F.col("_id") < 0, size + F.col("_id")).otherwise(F.col("_id")).alias(index)
    )
    found = lookup_join(asked, table.select(index, vector), index, "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", vector))))
    return found.groupBy(key).agg(F.transform(ordered, lambda e: e[vector]).alias("rows"))


def summarize_runs(df: DataFrame, value: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """Smallest, mean and largest value, overall or per group."""
    return df.groupBy(*by).agg(
        F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max")
    )
