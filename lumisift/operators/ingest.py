"""What is new, changed, seen or gone: the file listing against the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumisift.functions.paths import directory_prefix, prefix_filter
from lumisift.plans.running import dense_ids
from lumisift.plans.scratch import materialize
from lumisift.plans.skew import asked_for, lookup_join


def live_rows(manifest: DataFrame) -> DataFrame:
    """Rows that were not removed."""
    return manifest.where(F.col("path") != "")


def known_hashes(manifest: DataFrame) -> DataFrame:
    """Distinct fingerprints in the manifest; removed rows have none."""
    return manifest.where(F.col("content_hash") != "").select("content_hash").distinct()


def _with_stored(disk: DataFrame, manifest: DataFrame, how: str) -> DataFrame:
    stored = live_rows(manifest).select(
        "path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.lit(True).alias("_stored")
    )
    return disk.join(stored, "path", how)


def _differs() -> Column:
    return (F.col("mtime") != F.col("_mtime")) | (F.col("size") != F.col("_size"))


def detect_changed(disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of ``disk(path, mtime, size, ...)`` that are new or differ in mtime or size."""
    joined = _with_stored(disk, asked_for(manifest, disk, "path"), "left")
    return joined.where(F.col("_stored").isNull() | _differs()).drop("_mtime", "_size", "_stored")


def skip_seen_content(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of ``files(content_hash, ...)`` whose content the manifest does not hold yet.

    The test uses the manifest as it is: equal new files do not hide each other.
    A fingerprint shared by a third of the files is looked up where they lie.
    """
    known = known_hashes(asked_for(manifest, files, "content_hash"))
    return lookup_join(files, known, "content_hash", "left_anti")


def first_of_equal_content(files: DataFrame) -> DataFrame:
    """Of equal files in one batch, the one with the lowest path."""
    first = files.groupBy("content_hash").agg(F.min("path").alias("path"))
    return files.join(first, ["content_hash", "path"], "left_semi")


def detect_stale(manifest: DataFrame, disk: DataFrame, directory: str) -> DataFrame:
    """Manifest rows under ``directory`` whose path is not on disk any more."""
    inside = prefix_filter(live_rows(manifest), directory)
    return inside.join(disk.select("path"), "path", "left_anti").select(*manifest.columns)


def ingest_plan(
    disk: DataFrame,
    manifest: DataFrame,
    directory: str,
    update: bool = True,
    dedup_within_batch: bool = False,
    evict_first: bool = False,
) -> DataFrame:
    """One ``action`` per path: new, changed, seen, unchanged or stale.

    ``disk(path, mtime, size, content_hash)`` lists the files under ``directory``.
    ``update=False`` skips the change and stale tests, as a full reindex does.
    ``evict_first=True`` forgets the content of stale rows before the seen test,
    so that a renamed file is indexed in the same run. With
    ``dedup_within_batch`` only the first of equal new files counts as new.
    """
    listed = disk.select("path", "mtime", "size", "content_hash", F.lit(True).alias("_listed"))
    joined = _with_stored(listed, manifest, "full_outer" if update else "left")
    action = F.when(F.col("_stored").isNull(), "new").otherwise("changed")
    if update:
        inside = F.col("path").startswith(directory_prefix(directory))
        action = (
            F.when(F.col("_listed").isNull(), F.when(inside, "stale"))
            .when(F.col("_stored").isNotNull() & ~_differs(), "unchanged")
            .otherwise(action)
        )
    judged = joined.select("path", "content_hash", action.alias("action"))
    # Each file is fingerprinted and each table shuffled once; the rest works on this.
    judged = materialize(judged.where(F.col("action").isNotNull()), "plan")

    memory = manifest
    if evict_first:
        stale = judged.where(F.col("action") == "stale")
        # Removed rows all have the path '': as one key they would fill a task.
        memory = manifest.where("path != ''").join(stale.select("path"), "path", "left_anti")
        memory = memory.select(*manifest.columns).unionByName(manifest.where("path = ''"))
    is_fresh = F.col("action").isin("new", "changed")
    candidates = judged.where(is_fresh)
    seen = known_hashes(asked_for(memory, candidates, "content_hash")).withColumn("_seen", F.lit(True))
    tested = lookup_join(candidates, seen, "content_hash", "left")
    fresh_or_seen = F.when(F.col("_seen"), "seen").otherwise(F.col("action"))
    if dedup_within_batch:
        first = first_of_equal_content(candidates).select("path", F.lit(True).alias("_first"))
        tested = tested.join(first, "path", "left")
        fresh_or_seen = F.when(F.col("_seen") | F.col("_first").isNull(), "seen").otherwise(F.col("action"))
    tested = tested.select("path", fresh_or_seen.alias("action"))
    return tested.unionByName(judged.where(~is_fresh).select("path", "action"))


def ingest_counts(plan: DataFrame) -> DataFrame:
    """Number of paths per action."""
    return plan.groupBy("action").agg(F.count("*").alias("files"))


def assign_ids(batch: DataFrame, manifest: DataFrame, max_id: int) -> DataFrame:
    """Give each path of ``batch`` its ``image_id``: the stored one, or the next after ``max_id``.

    ``max_id`` counts removed rows too, so that no id is used twice. New ids go by path.
    """
    stored = live_rows(asked_for(manifest, batch, "path")).select("path", "image_id")
    known = batch.join(stored, "path")
    new = dense_ids(batch.join(stored, "path", "left_anti"), "path", start=max_id + 1)
    return known.unionByName(new)


def upsert_manifest(manifest: DataFrame, batch: DataFrame, max_id: int | None = None) -> DataFrame:
    """``manifest`` with the rows of ``batch`` (unique on path) replaced or appended."""
    if max_id is None:
        max_id = manifest.agg(F.coalesce(F.max("image_id"), F.lit(0))).first()[0]
    written = assign_ids(batch, manifest, max_id).select(*manifest.columns)
    kept = manifest.join(written.select("image_id"), "image_id", "left_anti")
    return kept.select(*manifest.columns).unionByName(written)


def tombstones(rows: DataFrame) -> DataFrame:
    """The given manifest rows as removed: path and fingerprint blank, id kept."""
    return rows.withColumn("path", F.lit("")).withColumn("content_hash", F.lit(""))


def remove_paths(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    """``manifest`` with the rows of ``paths(path)`` blanked; unknown paths change nothing."""
    gone = paths.select("path").distinct().withColumn("_gone", F.lit(True))
    keep = F.col("_gone").isNull()
    live = (
        manifest.where("path != ''").join(gone, "path", "left")
        .withColumn("content_hash", F.when(keep, F.col("content_hash")).otherwise(""))
        .withColumn("path", F.when(keep, F.col("path")).otherwise(""))
        .select(*manifest.columns)
    )
    # Rows removed earlier all have the path '': as one key they would fill a task.
    return live.unionByName(manifest.where("path = ''"))


def full_reindex(manifest: DataFrame) -> DataFrame:
    """Starting point of a full reindex: no rows, whatever directory they belong to."""
    return manifest.limit(0)
