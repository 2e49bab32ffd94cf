"""Files: listings, images, lists of paths and result lines."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumisift.catalog.search import run, search_sql
from lumisift.catalog.tables import DISK_SQL, IMAGES_SQL, images, table
from lumisift.functions.content import file_checksum
from lumisift.functions.paths import filter_extensions
from lumisift.operators.embed import preprocess_images
from lumisift.plans.jobs import with_fingerprints
from lumisift.plans.scratch import scratch_path
from lumisift.sources.files import (
    image_geometry, read_content, read_path_list, scan_files, scan_images, write_results,
)


def _write_texts(spark: SparkSession, folder: str) -> str:
    """Write every document as a file into a new shared folder; the folder."""
    target = scratch_path(spark, "texts")
    root = target.removeprefix("file:")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        for batch in batches:
            for group in batch.column(0).unique().to_pylist():
                files.create_dir(f"{base}/{group}", recursive=True)
            for group, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.open_output_stream(f"{base}/{group}/{name}.txt") as out:
                    out.write(content)
            yield batch.select([1])

    documents = table(spark, folder, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = documents.select(F.pmod("doc_id", F.lit(64)).alias("group"), "doc_id", F.encode("text", "UTF-8").alias("content"))
    rows.mapInArrow(write, "doc_id long").agg(F.count("*")).collect()
    return target


def _doc(path: str = "path") -> Column:
    return F.regexp_extract(path, r"(-?[0-9]+)\.txt$", 1).cast("long").alias("doc_id")


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as files, listed."""
    listed = scan_files(spark, _write_texts(spark, folder))
    return listed.select(_doc(), "size", (F.col("mtime") > 0).alias("dated"))


def _heads(spark: SparkSession, folder: str) -> DataFrame:
    listed = with_fingerprints(scan_files(spark, _write_texts(spark, folder)))
    return listed.select(_doc(), "content_hash")


def _sums(spark: SparkSession, folder: str) -> DataFrame:
    listed = read_content(scan_files(spark, _write_texts(spark, folder)), head=None)
    return listed.select(_doc(), file_checksum("content").alias("sha256"))


def _extensions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_extensions(table(spark, folder, "pages"), ["html"], "url").select("page_id", "url")


def png(width: int, height: int, rows: bytes) -> bytes:
    """A PNG file of RGB ``rows``."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    lines = b"".join(b"\0" + rows[y * width * 3:(y + 1) * width * 3] for y in range(height))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines))
            + chunk(b"IEND", b""))


def _draw(spark: SparkSession, folder: str) -> str:
    """Write every vector as an image of four lines into a new shared folder; the folder.

    Red is the entry, green its opposite, blue the entry from the other end. Images
    of label 0 are cut off, so that they cannot be decoded.
    """
    target = scratch_path(spark, "images")
    root = target.removeprefix("file:")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        files.create_dir(base, recursive=True)
        for batch in batches:
            for row in batch.itertuples():
                level = [int((float(x) + 1.0) * 127.5) for x in row.embedding]
                pixels = bytes(b for r, l in zip(level, reversed(level)) for b in (r, 255 - r, l))
                made = png(len(level) // 4, 4, pixels)
                with files.open_output_stream(f"{base}/{row.image_id}.png") as out:
                    out.write(made[:20] if row.label == 0 else made)
            yield batch[["image_id"]]

    drawn = images(spark, folder).select("image_id", "embedding", "label").mapInPandas(write, "image_id long")
    drawn.agg(F.count("*")).collect()
    return target


def _name(path: str = "path"):
    return F.regexp_extract(path, r"([0-9]+)\.png$", 1).cast("long").alias("image_id")


def _images(spark: SparkSession, folder: str) -> DataFrame:
    decoded = scan_images(spark, _draw(spark, folder))
    return decoded.select(_name(), "height", "width", F.sha2("data", 256).alias("pixels"))


def _geometry(spark: SparkSession, folder: str) -> DataFrame:
    root = _draw(spark, folder)
    every = scan_images(spark, root).unionByName(scan_images(spark, root, valid=False))
    return image_geometry(every).select(_name(), F.round("aspect", 4).alias("aspect"))


def _tensor_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(path, n, lowest, highest, total)`` of tensors ``(path, pixels)``."""
    for batch in batches:
        path, tensors = batch.columns
        # An expression over an array takes a call for each of its 150,000 numbers. Added up in their order, as there.
        each = [tensors[i].values.to_numpy() for i in range(len(tensors))]
        yield pa.RecordBatch.from_arrays([
            path, pa.array([len(x) for x in each], pa.int32()),
            pa.array([float(x.min()) for x in each], pa.float64()), pa.array([float(x.max()) for x in each], pa.float64()),
            pa.array([float(np.cumsum(x, dtype=np.float64)[-1]) for x in each], pa.float64()),
        ], names=["path", "n", "lowest", "highest", "total"])


def _preprocess(spark: SparkSession, folder: str) -> DataFrame:
    tensors = preprocess_images(scan_images(spark, _draw(spark, folder)))
    levels = tensors.mapInArrow(_tensor_levels, "path string, n int, lowest double, highest double, total double")
    return levels.select(
        _name(), "n", F.round("lowest", 4).alias("lowest"), F.round("highest", 4).alias("highest"),
        F.round(F.col("total") / F.col("n"), 4).alias("mean"))


def _path_list(spark: SparkSession, folder: str) -> DataFrame:
    """The addresses of all pages, with an empty line after each."""
    target = scratch_path(spark, "paths")
    lines = table(spark, folder, "pages").select(F.explode(F.array("url", F.lit(""))).alias("value"))
    lines.write.text(target)
    return read_path_list(spark, target)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_path(spark, "results")
    write_results(run(spark, folder, cutoff="none", limit=10), target)
    return spark.read.text(target).select(F.col("value").alias("line"))


QUERIES = {
    "scan_files": _scan,
    "scan_files_fingerprint": _heads,
    "scan_files_checksum": _sums,
    "filter_extensions": _extensions,
    "scan_images": _images,
    "image_geometry": _geometry,
    "preprocess_images": _preprocess,
    "read_path_list": _path_list,
    "write_results": _lines,
}

SQL = {
    # Empty files are not listed.
    "scan_files": """
SELECT doc_id, octet_length(encode(text)) AS size, true AS dated FROM documents WHERE text <> ''""",
    "scan_files_fingerprint": f"WITH {DISK_SQL} SELECT doc_id, content_hash FROM disk WHERE text <> ''",
    "scan_files_checksum": "SELECT doc_id, sha256(encode(text)) AS sha256 FROM documents WHERE text <> ''",
    "filter_extensions": r"""
SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '[^/]\.([^./]*)$', 1)) = 'html'""",
    "scan_images": f"""
WITH {IMAGES_SQL},
p AS (
  SELECT image_id, i, floor((e[i] + 1) * 127.5)::INTEGER AS r, floor((e[65 - i] + 1) * 127.5)::INTEGER AS b
  FROM v, unnest(range(1, 65)) AS t(i) WHERE label <> 0)
SELECT image_id, 4 AS height, 16 AS width,
       sha256(unhex(string_agg(printf('%02x%02x%02x', b, 255 - r, r), '' ORDER BY i))) AS pixels
FROM p GROUP BY image_id""",
    "image_geometry": """
SELECT vec_id + 1 AS image_id, CASE WHEN label = 0 THEN 1.5 ELSE 4.0 END::DOUBLE AS aspect FROM embeddings""",
    "read_path_list": "SELECT 0.0::DOUBLE AS score, url AS path FROM pages",
    "write_results": f"""
WITH {IMAGES_SQL}, {search_sql(50, '0', 10)} SELECT printf('%.4f', score) || chr(9) || path AS line FROM result""",
}
