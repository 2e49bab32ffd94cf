"""One ingest run over an index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lumisift.functions.content import content_fingerprint
from lumisift.functions.paths import filter_extensions
from lumisift.functions.vectors import valid_vectors
from lumisift.operators.embed import BATCH, EDGE, embed, preprocess_images
from lumisift.operators.ingest import (
    assign_ids, detect_changed, detect_stale, first_of_equal_content, live_rows, skip_seen_content,
    tombstones,
)
from lumisift.plans.scratch import materialize
from lumisift.plans.skew import asked_for
from lumisift.schema import MANIFEST
from lumisift.sources.files import full_path, missing_files, pick_images, read_content, scan_files
from lumisift.sources.store import IndexStore, State

# From files(path, mtime, size, content_hash) to the same rows with an embedding;
# rows that cannot be embedded are left out.
Embedder = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class IngestRun:
    """What a run did."""

    state: State
    indexed: int
    removed: int


def with_fingerprints(files: DataFrame) -> DataFrame:
    """Add ``content_hash`` by reading the heads of the listed files."""
    hashed = read_content(files).withColumn("content_hash", content_fingerprint("content", "size"))
    return hashed.drop("content")


def ingest(
    store: IndexStore,
    disk: DataFrame,
    embedder: Embedder,
    directory: str | None,
    dim: int,
    update: bool = True,
    dedup_within_batch: bool = False,
    refresh_mtime: bool = False,
    evict_first: bool = False,
    seen_version: int | None = None,
    source: str = "",
    look_first: bool = False,
) -> IngestRun:
    """Bring the index up to date with ``disk(path, mtime, size)``, the listing of ``directory``.

    Metadata is compared first; only files that differ are opened, and only their
    heads, unless ``disk`` brings a ``content_hash``. Files with known content are
    passed over, the others embedded, and the paths that are gone from ``directory``
    are removed; ``directory=None`` removes nothing. All of it is one commit.

    ``seen_version`` names the version whose content counts as known; by default
    the current one. ``refresh_mtime`` stores the new mtime of files that were touched
    but not changed. With ``look_first`` a path that the listing lacks is removed only if no
    file is there: listings leave out empty files and those of other kinds.
    """
    state = store.state()
    manifest = store.manifest(state)
    candidates = detect_changed(disk, manifest) if update else disk
    if "content_hash" not in disk.columns:
        candidates = with_fingerprints(candidates)
    candidates = materialize(
        candidates.select("path", "mtime", "size", "content_hash"), "candidates")
    stale = None
    if update and directory is not None:
        stale = detect_stale(manifest, disk, directory)
        if look_first:
            stale = materialize(missing_files(stale), "stale")
    memory = manifest if seen_version is None else store.manifest(seen_version)
    if evict_first and stale is not None:
        memory = memory.join(stale.select("path"), "path", "left_anti")
    fresh = skip_seen_content(candidates, memory)
    if dedup_within_batch:
        fresh = first_of_equal_content(fresh)
    fresh = materialize(fresh, "fresh")

    # The model runs once: what it made is stored before ids are given out.
    columns = ["path", "mtime", "size", "content_hash", "embedding"]
    embedded = valid_vectors(embedder(fresh), dim).select(
        *columns[:-1], F.col("embedding").cast("array<float>"))
    embedded = materialize(embedded, "embedded")
    known = asked_for(manifest, fresh, "path")
    rows = assign_ids(embedded.drop("embedding"), known, state.max_image_id)
    rows = rows.select(
        *rows.columns, F.lit(state.version + 1).cast("long").alias("vec_version"),
        (F.col("image_id") <= state.max_image_id).alias("voids"))
    if refresh_mtime:
        rows = rows.unionByName(_touched(candidates, embedded, manifest))
    if stale is not None:
        rows = rows.unionByName(tombstones(stale).withColumn("voids", F.lit(False)))
    # The staged rows are not visible yet; the counts and the vectors' ids come from them.
    staged = store.stage(rows, state)
    is_new = F.col("vec_version") > state.version
    counts = staged.agg(
        F.count("*").alias("rows"),
        F.count_if(is_new).alias("indexed"),
        F.count_if(F.col("path") == "").alias("removed"),
        F.count_if("voids").alias("voided"),
        F.coalesce(F.max("image_id"), F.lit(0)).alias("last"),
    ).first()
    if counts["rows"] == 0 and not source:
        return IngestRun(state, 0, 0)
    vectors = None
    if counts["indexed"]:
        ids = staged.where(is_new).select("path", "image_id")
        vectors = embedded.select("path", "embedding").join(ids, "path").drop("path")
    committed = store.commit(
        state, vectors, full=state.version == 0,
        max_image_id=max(state.max_image_id, counts["last"]), voided=counts["voided"],
        indexed=counts["indexed"], removed=counts["removed"], source=source,
    )
    return IngestRun(committed, counts["indexed"], counts["removed"])


def _touched(candidates: DataFrame, written: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stored rows whose file has the stored content and size but another mtime."""
    now = candidates.join(written.select("path"), "path", "left_anti").select(
        "path", "size", "content_hash", F.col("mtime").alias("_now"))
    same = live_rows(asked_for(manifest, now, "path")).join(now, ["path", "size", "content_hash"])
    return same.withColumn("mtime", F.col("_now")).select(
        *MANIFEST.fieldNames(), F.lit(False).alias("voids"))


def ingest_images(
    store: IndexStore,
    root: str,
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    dim: int,
    batch_size: int = BATCH,
    skip_failures: bool = True,
    **options,
) -> IngestRun:
    """Bring the index up to date with the images under ``root``.

    ``make_model`` is as for :func:`lumisift.operators.embed.embed`, over batches of
    ``[3, 224, 224]`` tensors; ``options`` go to :func:`ingest`. Images that cannot
    be decoded, or that the model fails on, are passed over.
    """

    def embedder(fresh: DataFrame) -> DataFrame:
        tensors = preprocess_images(pick_images(store.spark, root, fresh))
        vectors = embed(tensors, "pixels", make_model, dim, batch_size=batch_size,
                        tensor_shape=[3, EDGE, EDGE], skip_failures=skip_failures)
        return fresh.join(vectors.select("path", "embedding"), "path")

    listed = filter_extensions(scan_files(store.spark, root))
    return ingest(store, listed, embedder, full_path(store.spark, root), dim, **{"look_first": True} | options)
