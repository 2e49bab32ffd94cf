"""The stored index, and streams into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumisift.catalog.search import search_sql
from lumisift.catalog.tables import (
    DISK_SQL, IMAGES_SQL, TEXT_DIM, disk, image_manifest, image_vectors, images, label_queries,
    letter_model, stored,
)
from lumisift.catalog.vectors import FLOOR_1
from lumisift.operators.embed import embed
from lumisift.plans.jobs import ingest
from lumisift.plans.scratch import scratch_path
from lumisift.sources.store import IndexStore
from lumisift.streaming.ingest import LiveTopK, stream_ingest


def _new_store(spark: SparkSession) -> IndexStore:
    return IndexStore(spark, scratch_path(spark, "index"))


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    store = _new_store(spark)
    store.write_manifest(stored(spark, folder))
    return store.manifest()


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Two appends, read back by id."""
    store = _new_store(spark)
    every = images(spark, folder)
    for part in (F.col("label") < 5, F.col("label") >= 5):
        store.append_vectors(every.where(part).select("image_id", "embedding"))
    found = store.read_vectors(every.select("image_id"))
    return found.select("image_id", F.posexplode("embedding").alias("pos", "x")).select(
        "image_id", "pos", F.round(F.col("x").cast("double"), 4).alias("x"))


def _missing(spark: SparkSession, folder: str) -> DataFrame:
    """Ids whose vector was never appended."""
    store = _new_store(spark)
    every = images(spark, folder)
    store.append_vectors(every.where(F.col("label") < 5).select("image_id", "embedding"))
    return store.missing_vectors(every.select("image_id"))


def _reset(spark: SparkSession, folder: str) -> DataFrame:
    store = _new_store(spark)
    rows = image_manifest(spark, folder).select(
        "image_id", "path", F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("size"),
        F.col("path").alias("content_hash"), F.lit(1).cast("long").alias("vec_version"))
    full = store.write_manifest(rows, image_vectors(spark, folder))
    empty = store.reset()
    return _sizes(store, full.version, "before").unionByName(_sizes(store, empty.version, "after"))


def _sizes(store: IndexStore, version: int, name: str) -> DataFrame:
    rows = store.manifest(version).agg(F.count("*").alias("files"))
    vectors = store.vectors(version).agg(F.count("*").alias("vectors"))
    return rows.select(F.lit(name).alias("step"), "files", vectors.scalar().alias("vectors"))


def _read_text(files: DataFrame) -> DataFrame:
    return embed(files, "text", letter_model, TEXT_DIM)


def _ingest(spark: SparkSession, folder: str) -> DataFrame:
    """A batch run over the stored state: the manifest afterwards, removed rows included."""
    store = _new_store(spark)
    store.write_manifest(stored(spark, folder))
    files = disk(spark, folder)

    def embedder(fresh: DataFrame) -> DataFrame:
        return _read_text(fresh.join(files.select("path", "text"), "path"))

    ingest(store, files.select("path", "mtime", "size", "content_hash"), embedder, "/corpus", TEXT_DIM)
    return store.manifest().select("image_id", "path", "mtime", "size", "content_hash")


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same files as a stream of several micro-batches: the live rows afterwards."""
    store = _new_store(spark)
    store.write_manifest(stored(spark, folder))
    arriving = scratch_path(spark, "arriving")
    disk(spark, folder).repartition(6, "path").write.parquet(arriving)
    source = (
        spark.readStream.schema(spark.read.parquet(arriving).schema)
        .option("maxFilesPerTrigger", 2).parquet(arriving)
    )
    stream = stream_ingest(source, store, _read_text, TEXT_DIM, scratch_path(spark, "stream"))
    stream.awaitTermination()
    return store.manifest().select("path", "mtime", "size", "content_hash")


def _live(spark: SparkSession, folder: str) -> DataFrame:
    """Images as they arrive, and the label queries' results after the last of them."""
    store = _new_store(spark)
    arriving = scratch_path(spark, "arriving")
    images(spark, folder).select(
        "path", F.col("image_id").alias("mtime"), F.lit(1).cast("long").alias("size"),
        F.sha2("path", 256).alias("content_hash"), "embedding",
    ).repartition(3, "path").write.parquet(arriving)
    source = (
        spark.readStream.schema(spark.read.parquet(arriving).schema)
        .option("maxFilesPerTrigger", 1).parquet(arriving)
    )
    live = LiveTopK(label_queries(spark, folder), "/corpus", sigmas=1.0)
    stream = stream_ingest(source, store, lambda df: df, TEXT_DIM, scratch_path(spark, "stream"),
                           after_batch=live)
    stream.awaitTermination()
    return live.results(store).select("query_id", "rank", "path", F.round("score", 4).alias("score"))


QUERIES = {
    "read_write_manifest": _manifest,
    "append_read_vectors": _vectors,
    "missing_vectors": _missing,
    "reset_index": _reset,
    "ingest": _ingest,
    "stream_ingest": _stream,
    "live_topk": _live,
}

SQL = {
    "read_write_manifest": f"WITH {DISK_SQL} SELECT * FROM manifest",
    "append_read_vectors": """
SELECT vec_id + 1 AS image_id, (i - 1)::INTEGER AS pos, round(embedding[i]::DOUBLE, 4) + 0.0 AS x
FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i)""",
    "missing_vectors": "SELECT vec_id + 1 AS image_id FROM embeddings WHERE label >= 5",
    "reset_index": """
SELECT 'before' AS step, count(*) AS files, count(*) AS vectors FROM embeddings
UNION ALL SELECT 'after', 0, 0""",
    "ingest": f"""
WITH {DISK_SQL}, gone AS (
  SELECT path FROM manifest WHERE starts_with(path, '/corpus/') AND path NOT IN (SELECT path FROM disk))
SELECT image_id, CASE WHEN path IN (FROM gone) THEN '' ELSE path END AS path, mtime, size,
       CASE WHEN path IN (FROM gone) THEN '' ELSE content_hash END AS content_hash
FROM upserted""",
    "stream_ingest": f"WITH {DISK_SQL} SELECT path, mtime, size, content_hash FROM upserted",
    "live_topk": f"""
WITH {IMAGES_SQL}, {search_sql(500, FLOOR_1)}
SELECT query_id, rank, path, round(score, 4) + 0.0 AS score FROM result""",
}
