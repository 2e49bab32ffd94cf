"""Files against a list of expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: this checksum stands for "not known yet" and accepts any file.
UNKNOWN_CHECKSUM = "0" * 64


def verify_checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``status`` of each of ``expected(filename, sha256)``: ok, mismatch, missing or unverified.

    ``files(filename, sha256)`` holds the checksums of the files that are there.
    """
    actual = files.select("filename", F.col("sha256").alias("_actual"))
    status = (
        F.when(F.col("_actual").isNull(), "missing")
        .when(F.col("sha256") == UNKNOWN_CHECKSUM, "unverified")
        .when(F.col("sha256") == F.col("_actual"), "ok")
        .otherwise("mismatch")
    )
    return expected.join(actual, "filename", "left").select("filename", status.alias("status"))


def orphan_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that the known list does not name."""
    return files.join(known.select("filename"), "filename", "left_anti")
