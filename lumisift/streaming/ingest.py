"""Ingest as files arrive, with results that follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lumisift.functions.content import content_fingerprint
from lumisift.functions.paths import directory_prefix
from lumisift.functions.vectors import noise_floor
from lumisift.operators.cutoff import Cutoff, parse_cutoff
from lumisift.operators.search import finish_search, searched
from lumisift.operators.topk import as_blocks, knn_exact, merge_top
from lumisift.plans.blocks import Blocks
from lumisift.plans.jobs import ingest
from lumisift.plans.scratch import materialize
from lumisift.sources.files import plain_path
from lumisift.sources.store import IndexStore, State

# Fixed value: files per micro-batch.
BATCH_FILES = 64

AfterBatch = Callable[[IndexStore, State, State], None]


def stream_files(spark: SparkSession, root: str, files: int = BATCH_FILES) -> DataFrame:
    """Arriving files as ``(path, mtime, size, content_hash, content)``."""
    read = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).load(root)
    )
    return read.select(
        plain_path("path").alias("path"),
        F.coalesce(F.unix_timestamp("modificationTime"), F.lit(0)).alias("mtime"),
        F.col("length").alias("size"),
        content_fingerprint("content", "length").alias("content_hash"),
        "content",
    )


def stream_ingest(
    source: DataFrame,
    store: IndexStore,
    embed: Callable[[DataFrame], DataFrame],
    dim: int,
    checkpoint: str,
    name: str = "ingest",
    after_batch: AfterBatch | None = None,
    snapshot: bool = True,
) -> StreamingQuery:
    """Ingest ``source(path, mtime, size, content_hash, ...)`` micro-batch by micro-batch.

    ``embed`` adds ``embedding`` to rows of the source. Each batch is one commit with
    the batch number in it, and a batch that comes again after a crash is passed over.
    With ``snapshot`` the content that counts as known is that of the version the
    stream started from, so that the result equals one batch run over all the files.
    Nothing is removed: a micro-batch does not list a directory.
    """
    started = store.state().version if snapshot else None

    def take(batch: DataFrame, number: int) -> None:
        tag = f"{name}/{number}"
        before = store.state()
        done = store.commits().where(F.col("source") == tag)
        if done.isEmpty():
            # The batch is read twice: for its listing and for the content of what is left.
            def embedder(fresh: DataFrame) -> DataFrame:
                known = ["path", "mtime", "size", "content_hash"]
                return embed(batch.join(fresh.select("path"), "path", "left_semi")).select(
                    *known, "embedding")

            listing = materialize(batch.select("path", "mtime", "size", "content_hash"), "listing")
            run = ingest(store, listing, embedder, None, dim, seen_version=started, source=tag)
            after = run.state
        else:
            after = before
        if after_batch:
            after_batch(store, before, after)

    return (
        source.writeStream.foreachBatch(take).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).start()
    )


class LiveTopK:
    """Results of fixed queries, brought up to date after every micro-batch.

    The candidate pools are kept. A batch that only adds images is searched by
    itself and merged into them, so a refresh costs what the batch costs; a batch
    that replaces vectors makes the pools from the whole index again.
    """

    def __init__(
        self,
        queries: DataFrame | Blocks,
        directory: str,
        limit: int = 0,
        cutoff: Cutoff = "auto",
        sigmas: float = 3.0,
        query_id: str = "query_id",
        pool: int | None = None,
    ):
        self.pool = searched(parse_cutoff(cutoff), limit, pool)
        self.blocks = as_blocks(queries, query_id)
        self.directory = directory_prefix(directory)
        self.limit = limit
        self.cutoff = parse_cutoff(cutoff)
        self.floor = noise_floor(max(self.blocks.dim, 1), sigmas)
        self.query_id = query_id
        self.pools: DataFrame | None = None
        self.state: State | None = None
        self.refreshed = 0

    def __call__(self, store: IndexStore, before: State, after: State) -> None:
        if self.state and after.version == self.state.version:
            return
        size = self.pool
        follows = self.state and before.version == self.state.version
        if follows and after.voided == before.voided and after.base == before.base:
            added = store.added_vectors(before.version, after)
            found = knn_exact(self.blocks, added, size, self.query_id)
            pools = merge_top(self.pools.drop("rank").unionByName(found.drop("rank")), size, self.query_id)
        else:
            pools = knn_exact(self.blocks, store.vectors(after), size, self.query_id)
        self.pools = materialize(pools, "pools")
        self.state = after
        self.refreshed += 1

    def results(self, store: IndexStore) -> DataFrame:
        """Current results, as of the last refresh."""
        return finish_search(
            self.pools, store.manifest(self.state), self.directory, self.limit, self.cutoff,
            self.floor, self.query_id, most=self.blocks.rows * self.pool,
        )
