"""Files: listing, heads, images, path lists and result lines."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lumisift.functions.content import HEAD_BYTES
from lumisift.operators.search import result_lines
from lumisift.plans.scratch import scratch_path
from lumisift.plans.size import spread


# So many names of a folder are handed on together.
LISTED = 10_000


def plain_path(path: Column | str) -> Column:
    """A local path without the ``file:`` that Spark's file source puts before it."""
    return F.regexp_replace(path, "^file:/*", "/")


def full_path(spark: SparkSession, path: str) -> str:
    """``path`` in the form in which :func:`scan_files` lists it, for use as a directory."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return re.sub("^file:/*", "/", files.makeQualified(hadoop).toString())


_LISTED = "path string, mtime long, size long, folder boolean"


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, mtime, size)`` of all files under ``root``, as they are now; no content is read.

    As with Spark's file source, empty files and names that start with a dot or underscore are left
    out, ``root`` may be a pattern, and symbolic links are followed. Tasks list the folders, level by
    level, into a table in the shared folder: the driver learns no name but that of the root. A store
    that Arrow does not reach is listed by Spark's file source, in the driver.
    """
    level, levels = _starts(spark, root), []
    if level is None:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return listed.select(
            plain_path("path").alias("path"),
            F.coalesce(F.unix_timestamp("modificationTime"), F.lit(0)).alias("mtime"),
            F.col("length").alias("size"),
        )
    while not levels or not level.isEmpty():
        levels.append(scratch_path(spark, "listing"))
        level.mapInArrow(_folders_listed, _LISTED).write.parquet(levels[-1])
        level = spark.read.schema(_LISTED).parquet(levels[-1]).where("folder").select("path")
        level = level.repartition(spark.sparkContext.defaultParallelism)
    return spark.read.schema(_LISTED).parquet(*levels).where("NOT folder").select("path", "mtime", "size")


def _starts(spark: SparkSession, root: str) -> DataFrame | None:
    """``(path)`` of what ``root`` names; none if it names nothing that Arrow reaches."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    named = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop) or []
    paths = [re.sub("^file:/*", "/", status.getPath().toString()) for status in named]
    try:
        if not paths or any(_is_gone({}, path) for path in paths):
            return None
    except (pa.ArrowException, OSError):
        return None
    return spark.createDataFrame([(path,) for path in paths], "path string")


def _folders_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in the folders of a column of paths; of a file, itself."""
    opened: dict[tuple[str, str], tuple[pafs.FileSystem, str]] = {}
    for batch in batches:
        for path in batch.column(0).to_pylist():
            found = [(at, info) for at, info in _tried(_entries, opened, path) if _is_listed(info)]
            for low in range(0, len(found), LISTED):
                part = found[low:low + LISTED]
                yield pa.RecordBatch.from_arrays([
                    pa.array([at for at, _ in part], pa.string()),
                    pc.divide(pa.array([info.mtime_ns or 0 for _, info in part], pa.int64()), 1_000_000_000),
                    pa.array([info.size or 0 for _, info in part], pa.int64()),
                    pa.array([info.type == pafs.FileType.Directory for _, info in part], pa.bool_()),
                ], names=["path", "mtime", "size", "folder"])


def _entries(opened: dict, path: str) -> list[tuple[str, pafs.FileInfo]]:
    system, inner = _locate(opened, path)
    own = system.get_file_info(inner)
    if own.type != pafs.FileType.Directory:
        return [(path, own)]
    found = system.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    return [(f"{path.rstrip('/')}/{info.base_name}", info) for info in found]


def _is_listed(info: pafs.FileInfo) -> bool:
    """The rule of Spark's file source, which enters folders of Parquet's metadata."""
    name = info.base_name
    hidden = name.startswith(".") or name.startswith("_") and "=" not in name
    if info.type == pafs.FileType.Directory:
        return name.startswith(("_metadata", "_common_metadata")) or not (hidden or name.endswith("._COPYING_"))
    return info.type == pafs.FileType.File and info.size != 0 and not (hidden or name.endswith("._COPYING_"))


def read_content(files: DataFrame, head: int | None = HEAD_BYTES, path: str = "path") -> DataFrame:
    """Add ``content`` of the files in ``path``: the first ``head`` bytes, or all with ``None``.

    Only the listed files are opened, and only their heads are read, so that
    fingerprints of a few changed files do not cost a read of the whole collection.
    A file that is gone or may not be read is left out, see :func:`rejected_files`. Where the
    store itself cannot be reached, also on a third try, the job fails.
    """
    return _contents(files, head, path).where("_reason IS NULL").drop("_reason")


def rejected_files(files: DataFrame, path: str = "path") -> DataFrame:
    """``(path, reason)`` of the ``files`` that :func:`read_content` leaves out."""
    failed = _contents(files, 1, path).where("_reason IS NOT NULL")
    return failed.select(F.col(path).alias("path"), F.col("_reason").alias("reason"))


def _contents(files: DataFrame, head: int | None, path: str) -> DataFrame:
    """``files`` with ``content``, or with the ``_reason`` why there is none."""
    schema = T.StructType([
        *files.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("_reason", T.StringType())])
    position = files.columns.index(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[tuple[str, str], tuple[pafs.FileSystem, str]] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [_read(opened, p, head) for p in part.column(position).to_pylist()]
                content = pa.array([c for c, _ in found], pa.binary())
                reason = pa.array([r for _, r in found], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, content, reason], names=schema.fieldNames())

    return spread(files).mapInArrow(read, schema)


def missing_files(files: DataFrame, path: str = "path") -> DataFrame:
    """The rows of ``files`` whose file is not there. Empty files, which no listing names, are."""
    return _looked_up(files, path, gone=True)


def _looked_up(files: DataFrame, path: str, gone: bool) -> DataFrame:
    position = files.columns.index(path)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[tuple[str, str], tuple[pafs.FileSystem, str]] = {}
        for batch in batches:
            kept = [(p is None or _tried(_is_gone, opened, p)) == gone for p in batch.column(position).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return files.mapInArrow(look, files.schema)


def _is_gone(opened: dict, path: str) -> bool:
    system, inner = _locate(opened, path)
    return system.get_file_info(inner).type == pafs.FileType.NotFound


def _read(opened: dict, path: str | None, head: int | None) -> tuple[bytes | None, str | None]:
    if path is None:
        return None, "no path"
    try:
        return _tried(_head, opened, path, head), None
    except _OF_THE_FILE as error:
        return None, str(error)


def _head(opened: dict, path: str, head: int | None) -> bytes:
    system, inner = _locate(opened, path)
    with system.open_input_file(inner) as file:
        return file.read() if head is None else file.read(head)


def _locate(opened: dict, path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path's scheme and host, and the path within it."""
    scheme, remote, rest = path.partition("://")
    if not remote:
        scheme, rest = "file", path
    host, _, inner = rest.partition("/")
    if not remote and host:
        return pafs.LocalFileSystem(), path
    if (scheme, host) not in opened:
        known = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
        # Only the root is parsed as a URI: listed paths are not escaped.
        opened[scheme, host] = pafs.FileSystem.from_uri(f"{known}://{host}/")
    system, root = opened[scheme, host]
    return system, f"{root.rstrip('/')}/{inner}"


# What a file is to blame for, not the store.
_OF_THE_FILE = (FileNotFoundError, PermissionError, IsADirectoryError)
_TRIES = 3


def _tried(step: Callable, *given):
    """``step(*given)``, again after a pause if the store fails."""
    for n in range(1, _TRIES + 1):
        try:
            return step(*given)
        except OSError as error:
            if isinstance(error, _OF_THE_FILE) or n == _TRIES:
                raise
            time.sleep(n)


def scan_images(spark: SparkSession, root: str, valid: bool = True) -> DataFrame:
    """Decoded images ``(path, height, width, nChannels, mode, data)`` under ``root``, pixels as BGR.

    ``valid=False`` gives the files that could not be decoded instead.
    """
    reader = spark.read.format("image").option("recursiveFileLookup", True)
    if valid:
        return _image_columns(reader.option("dropInvalid", True).load(root))
    return _image_columns(reader.load(root)).where(F.col("width") < 0)


# So many paths may be named one by one.
NAMED_PATHS = 10_000


def pick_images(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Decoded images of ``files(path)`` under ``root``, which are all or a few of those there.

    A few are read by name, so that an update decodes what it needs. Spark's image
    source takes no filter, so for more than 10,000 it reads all and keeps the asked.
    Files that are gone are left out either way.
    """
    paths = files.select("path")
    here = _looked_up(paths, "path", gone=False)
    named = [row.path for row in here.limit(NAMED_PATHS + 1).collect()]
    if not named:
        return scan_images(spark, root).limit(0)
    if len(named) > NAMED_PATHS:
        return scan_images(spark, root).join(paths, "path", "left_semi")
    # A path is read as a pattern: its special characters are escaped.
    escaped = [re.sub(r"([*?\[\]{}\\])", r"\\\1", path) for path in named]
    reader = spark.read.format("image").option("dropInvalid", True)
    return _image_columns(reader.load(escaped))


def _image_columns(images: DataFrame) -> DataFrame:
    # The image source gives its paths in URL encoding, where a plus is a plus.
    origin = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))
    return images.select(
        plain_path(origin).alias("path"),
        "image.height", "image.width", "image.nChannels", "image.mode", "image.data",
    )


def image_geometry(images: DataFrame) -> DataFrame:
    """``(path, aspect)``: width by height, 1.5 for an image that could not be read."""
    ratio = F.col("width") / F.greatest(F.col("height"), F.lit(1))
    return images.select("path", F.when(F.col("width") > 0, ratio).otherwise(1.5).alias("aspect"))


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """``(score, path)`` of a text file of paths: score 0, empty lines left out."""
    lines = spark.read.text(path).where(F.length("value") > 0)
    return lines.select(F.lit(0.0).alias("score"), F.col("value").alias("path"))


def write_results(
    results: DataFrame, path: str, scores: bool = True, query_id: str = "query_id"
) -> None:
    """Write one line per result in rank order, as text."""
    ordered = result_lines(results, scores).orderBy(query_id, "rank")
    ordered.select("line").write.text(path)
