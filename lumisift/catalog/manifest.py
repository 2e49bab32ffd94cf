"""File states against the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumisift.catalog.tables import DISK_SQL, disk, stored, table
from lumisift.functions.content import content_fingerprint, file_checksum
from lumisift.operators.checks import UNKNOWN_CHECKSUM, orphan_files, verify_checksums
from lumisift.operators.ingest import (
    detect_changed, detect_stale, ingest_counts, ingest_plan, remove_paths, skip_seen_content,
    upsert_manifest,
)
from lumisift.plans.scratch import materialize


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    return disk(spark, folder).select("path", "mtime", "size", "content_hash")


def _fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return disk(spark, folder).select("doc_id", "content_hash")


def _checksum(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents")
    return texts.select("doc_id", file_checksum(F.encode("text", "UTF-8")).alias("sha256"))


def _changed(spark: SparkSession, folder: str) -> DataFrame:
    return detect_changed(_listing(spark, folder).drop("content_hash"), stored(spark, folder))


def _stored_table(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest as a table on disk, for queries that read it several times."""
    return materialize(stored(spark, folder), "manifest")


def fresh(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    """Files to be indexed: changed ones whose content is not known."""
    changed = materialize(detect_changed(_listing(spark, folder), known), "changed")
    return skip_seen_content(changed, known)


def _fresh(spark: SparkSession, folder: str) -> DataFrame:
    return fresh(spark, folder, _stored_table(spark, folder)).select("path", "content_hash")


def _stale(spark: SparkSession, folder: str) -> DataFrame:
    return detect_stale(stored(spark, folder), _listing(spark, folder), "/corpus").select("image_id", "path")


def _plan(**options):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return ingest_plan(_listing(spark, folder), _stored_table(spark, folder), "/corpus", **options)

    return query


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return ingest_counts(_plan()(spark, folder))


def _upsert(spark: SparkSession, folder: str) -> DataFrame:
    known = _stored_table(spark, folder)
    batch = fresh(spark, folder, known).withColumn("vec_version", F.lit(2).cast("long"))
    return upsert_manifest(known, materialize(batch, "batch"))


def _remove(spark: SparkSession, folder: str) -> DataFrame:
    """Files in English are gone, and so is one that was never there."""
    gone = table(spark, folder, "documents").where(F.col("lang") == "en").select("doc_id")
    paths = disk(spark, folder).join(gone, "doc_id", "left_semi").select("path")
    unknown = spark.range(1).select(F.lit("/nowhere").alias("path"))
    return remove_paths(stored(spark, folder), paths.unionByName(unknown)).select(
        "image_id", "path", "content_hash", "size")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        file_checksum(F.encode("text", "UTF-8")).alias("sha256"))


def _verify(spark: SparkSession, folder: str) -> DataFrame:
    """German files are expected with another checksum, French with none; Spanish are absent."""
    files = _files(spark, folder)
    expected = files.select("filename", (
        F.when(F.col("lang") == "de", F.reverse("sha256"))
        .when(F.col("lang") == "fr", F.lit(UNKNOWN_CHECKSUM)).otherwise(F.col("sha256"))
    ).alias("sha256"))
    return verify_checksums(files.where(F.col("lang") != "es"), expected)


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "labels").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"))
    return orphan_files(_files(spark, folder).select("filename"), known)


QUERIES = {
    "content_fingerprint": _fingerprint,
    "file_checksum": _checksum,
    "detect_changed": _changed,
    "skip_seen_content": _fresh,
    "detect_stale": _stale,
    "ingest_plan": _plan(),
    "ingest_plan_once_per_content": _plan(dedup_within_batch=True),
    "ingest_plan_reindex": _plan(update=False),
    "ingest_counts": _counts,
    "upsert_manifest": _upsert,
    "remove_paths": _remove,
    "verify_checksums": _verify,
    "orphan_files": _orphans,
}

_KNOWN = "d.content_hash IN (SELECT content_hash FROM manifest WHERE content_hash <> '')"
_PLAN_SQL = f"""
WITH {DISK_SQL},
plan AS (
  SELECT path, CASE WHEN m.path IS NOT NULL AND m.mtime = d.mtime AND m.size = d.size THEN 'unchanged'
                    WHEN {_KNOWN} THEN 'seen'
                    WHEN m.path IS NULL THEN 'new' ELSE 'changed' END AS action
  FROM disk d LEFT JOIN manifest m USING (path)
  UNION ALL
  SELECT path, 'stale' FROM manifest
  WHERE starts_with(path, '/corpus/') AND path NOT IN (SELECT path FROM disk))"""

SQL = {
    "content_fingerprint": f"WITH {DISK_SQL} SELECT doc_id, content_hash FROM disk",
    "file_checksum": "SELECT doc_id, sha256(encode(text)) AS sha256 FROM documents",
    "detect_changed": f"WITH {DISK_SQL} SELECT path, mtime, size FROM changed",
    "skip_seen_content": f"WITH {DISK_SQL} SELECT path, content_hash FROM fresh",
    "detect_stale": f"""
WITH {DISK_SQL} SELECT image_id, path FROM manifest
WHERE starts_with(path, '/corpus/') AND path NOT IN (SELECT path FROM disk)""",
    "ingest_plan": f"{_PLAN_SQL} SELECT path, action FROM plan",
    "ingest_plan_once_per_content": f"""{_PLAN_SQL}
SELECT path, CASE WHEN action IN ('new', 'changed')
                   AND path <> min(path) FILTER (action IN ('new', 'changed')) OVER (PARTITION BY content_hash)
                  THEN 'seen' ELSE action END AS action
FROM plan LEFT JOIN disk USING (path)""",
    "ingest_plan_reindex": f"""
WITH {DISK_SQL} SELECT path, CASE WHEN {_KNOWN} THEN 'seen' WHEN m.path IS NULL THEN 'new'
                                  ELSE 'changed' END AS action
FROM disk d LEFT JOIN manifest m USING (path)""",
    "ingest_counts": f"{_PLAN_SQL} SELECT action, count(*) AS files FROM plan GROUP BY action",
    "upsert_manifest": f"WITH {DISK_SQL} SELECT * FROM upserted",
    "remove_paths": f"""
WITH {DISK_SQL},
gone AS (SELECT path FROM disk JOIN documents USING (doc_id) WHERE lang = 'en')
SELECT image_id, CASE WHEN path IN (FROM gone) THEN '' ELSE path END AS path,
       CASE WHEN path IN (FROM gone) THEN '' ELSE content_hash END AS content_hash, size
FROM manifest""",
    "verify_checksums": """
SELECT doc_id || '.txt' AS filename,
       CASE lang WHEN 'es' THEN 'missing' WHEN 'fr' THEN 'unverified' WHEN 'de' THEN 'mismatch'
                 ELSE 'ok' END AS status
FROM documents""",
    "orphan_files": """
SELECT doc_id || '.txt' AS filename FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
}
