"""Batch inference: a user's model over a column, and image tensors for it."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F, types as T

from lumisift.functions.vectors import MIN_NORM, valid_vectors
from lumisift.operators.tokenize import MAX_TOKENS, bpe_encode
from lumisift.plans.size import spread

# Fixed values of the image tensor.
EDGE = 224
LARGEST = 1024
BATCH = 64
# So many tensors of 600 kB are handed on together.
TENSORS = 8


def embed(
    df: DataFrame,
    col: str,
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    dim: int,
    out: str = "embedding",
    batch_size: int = BATCH,
    tensor_shape: list[int] | None = None,
    skip_failures: bool = False,
) -> DataFrame:
    """Add unit vectors ``make_model()(values of col)``; rows of another dimension are left out.

    ``make_model`` runs once per worker process and returns a function from a batch of
    values to a matrix with one row per value. A column of flat tensors, such as that of
    :func:`preprocess_images`, needs ``tensor_shape``, ``[3, 224, 224]`` there.

    With ``skip_failures`` a value that makes the model raise is left out too, instead of
    stopping the job.
    """

    def make_unit_model() -> Callable[[np.ndarray], np.ndarray]:
        model = make_model()
        run = _one_by_one(model, dim) if skip_failures else model
        return lambda values: unit_rows(run(values))

    predict = predict_batch_udf(
        make_unit_model,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[tensor_shape] if tensor_shape else None,
    ).asNondeterministic()  # or Spark runs the model again for the filter on its result
    return valid_vectors(spread(df).withColumn(out, predict(F.col(col))), dim, out)


def _one_by_one(model: Callable[[np.ndarray], np.ndarray], dim: int):
    """``model`` over a batch or, if that fails, over its values; NaN for those that fail."""

    def run(values: np.ndarray) -> np.ndarray:
        try:
            return model(values)
        except Exception:  # whatever the model raises
            rows = np.full((len(values), dim), np.nan)
        for i in range(len(values)):
            try:
                rows[i] = model(values[i:i + 1])[0]
            except Exception as error:
                print(f"skip value: {error}", file=sys.stderr)
        return rows

    return run


def embed_text(
    df: DataFrame,
    col: str,
    vocab: DataFrame,
    rules: DataFrame,
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    dim: int,
    out: str = "embedding",
) -> DataFrame:
    """Add unit vectors of texts: token ids first, then a model over ``[64]`` of them."""
    tokens = bpe_encode(df, col, vocab, rules, out="_tokens")
    return embed(tokens, "_tokens", make_model, dim, out, tensor_shape=[MAX_TOKENS]).drop("_tokens")


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows at length 1; a row of almost no length is kept."""
    lengths = np.linalg.norm(np.asarray(matrix, np.float64), axis=1, keepdims=True)
    return (matrix / np.where(lengths > MIN_NORM, lengths, 1.0)).astype(np.float32)


def triangle_weights(source: int, target: int) -> np.ndarray:
    """Weights ``[target, source]`` of a resize with the triangle filter."""
    ratio = source / target
    spread = max(ratio, 1.0)
    centre = (np.arange(target) + 0.5) * ratio
    position = np.arange(source) + 0.5
    weights = np.clip(1.0 - np.abs(position[None, :] - centre[:, None]) / spread, 0.0, None)
    return weights / weights.sum(axis=1, keepdims=True)


def shrink(pixels: np.ndarray, largest: int = LARGEST) -> np.ndarray:
    """Fit an image into a square by the mean of the pixels that fall together."""
    height, width = pixels.shape[:2]
    if max(height, width) <= largest:
        return pixels
    ratio = min(largest / width, largest / height)
    rows, cols = (max(int(edge * ratio + 0.5), 1) for edge in (height, width))
    row_cuts = np.ceil(np.arange(rows) * (height / rows)).astype(int)
    col_cuts = np.ceil(np.arange(cols) * (width / cols)).astype(int)
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), row_cuts, axis=0), col_cuts, axis=1)
    counts = np.outer(np.diff([*row_cuts, height]), np.diff([*col_cuts, width]))[:, :, None]
    return ((sums + counts // 2) // counts).astype(np.uint8)


# What a level of 0 to 255 becomes.
_LEVELS = ((np.arange(256) / 255.0 - 0.5) / 0.5).astype(np.float32)


def image_tensor(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixels as Spark's image source gives them (BGR rows) to a normalised RGB tensor."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        pixels = np.repeat(pixels, 3, axis=2)
    pixels = shrink(pixels[:, :, 2::-1])
    down = triangle_weights(pixels.shape[0], EDGE)
    across = triangle_weights(pixels.shape[1], EDGE)
    resized = np.einsum("ah,hwc,bw->cab", down, pixels.astype(np.float64), across, optimize=True)
    # In place: fresh arrays of this size cost more time than the sums. The cast cuts off, and so rounds.
    np.clip(resized, 0, 255, out=resized)
    resized += 0.5
    return _LEVELS.take(resized.astype(np.uint8))


def preprocess_images(images: DataFrame, out: str = "pixels") -> DataFrame:
    """``(path, pixels)`` of decoded ``images(path, height, width, nChannels, data)``.

    The tensor is ``[3, 224, 224]``, flattened; tasks hand on a few rows at a time.
    """
    schema = T.StructType([
        T.StructField("path", T.StringType()), T.StructField(out, T.ArrayType(T.FloatType()))
    ])
    length = 3 * EDGE * EDGE

    def tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TENSORS):
                part = batch.slice(low, TENSORS)
                path, *image = part.columns
                made = np.empty((part.num_rows, length), np.float32)
                for row, values in zip(made, zip(*(c.to_pylist() for c in image), strict=True), strict=True):
                    row[:] = image_tensor(*values).ravel()
                ends = pa.array(np.arange(part.num_rows + 1) * length, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [path, pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], names=schema.fieldNames())

    images = spread(images)
    return images.select("path", "data", "height", "width", "nChannels").mapInArrow(tensors, schema)
