"""Path predicates and parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# File extensions that count as images.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tiff", "tif", "webp", "avif")


def extension(path: Column | str) -> Column:
    """Lower-case extension of the file name, '' without one.

    A name that only starts with a dot has no extension.
    """
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def directory_prefix(directory: str) -> str:
    """With one slash at the end, so that /a does not cover /ab."""
    return directory.rstrip("/") + "/"


def filter_extensions(
    df: DataFrame, extensions: Sequence[str] = IMAGE_EXTENSIONS, path: str = "path"
) -> DataFrame:
    return df.where(extension(path).isin([e.lower() for e in extensions]))


def prefix_filter(df: DataFrame, directory: str, path: str = "path") -> DataFrame:
    return df.where(F.col(path).startswith(directory_prefix(directory)))
