"""Vector arithmetic on array columns. Sums are taken in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: a shorter vector is left as it is by normalisation.
MIN_NORM = 1e-6

# Scores are compared at this many digits, so that the order of equal scores is
# decided by id and not by the order in which a sum was taken.
SCORE_DIGITS = 10


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products: the cosine of two unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def score(a: Column | str, b: Column | str) -> Column:
    return F.round(dot(a, b), SCORE_DIGITS)


def norm(v: Column | str) -> Column:
    squares = F.transform(v, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector of ``v``, as floats; a vector of almost no length is kept."""
    v = F.col(v) if isinstance(v, str) else v
    # Through the one-entry array the length is taken once per vector, not once per entry.
    divisor = F.array(F.when(norm(v) > MIN_NORM, norm(v)).otherwise(1.0))
    return F.transform(
        divisor, lambda n: F.transform(v, lambda x: (x.cast("double") / n).cast("float")))[0]


def noise_floor(dim: int | Column, k: float = 3.0) -> float | Column:
    """Random unit vectors in ``dim`` dimensions score about 0 +- 1/sqrt(dim); k sigmas of it."""
    return F.lit(k) / F.sqrt(dim) if isinstance(dim, Column) else k / math.sqrt(dim)


def has_dim(v: Column | str, dim: int) -> Column:
    """True for vectors of ``dim`` numbers without a NaN."""
    return (F.size(v) == dim) & ~F.exists(v, lambda x: F.isnan(x) | x.isNull())


def valid_vectors(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    return df.where(F.coalesce(has_dim(vector, dim), F.lit(False)))


def rejected_vectors(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """What :func:`valid_vectors` leaves out."""
    return df.where(~F.coalesce(has_dim(vector, dim), F.lit(False)))
