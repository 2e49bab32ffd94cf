import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.operators.search import search
from lumisift.plans.jobs import ingest
from lumisift.plans.scratch import scratch_path
from lumisift.sources.store import IndexStore
from lumisift.streaming.ingest import LiveTopK, stream_files, stream_ingest


def letters(df):
    """A vector of eight numbers from the content's hash."""
    digest = F.sha2("content", 256)
    return df.withColumn("embedding", F.array(*[
        (F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("float") - 128) / 128 for i in range(8)
    ]).cast("array<float>"))


@pytest.fixture
def folder(tmp_path):
    for i in range(23):
        (tmp_path / f"f{i:02d}.txt").write_bytes(f"content {i % 20}".encode())
    return tmp_path


def live(store):
    return sorted((r.path, r.size, r.content_hash) for r in store.manifest().where("path <> ''").collect())


def test_stream_equals_batch(spark, folder):
    queries = spark.createDataFrame(
        [(q, [float(x) for x in np.random.default_rng(q).normal(size=8)]) for q in range(3)],
        "query_id long, embedding array<float>")
    top = LiveTopK(queries, str(folder), limit=4, cutoff="none")
    streamed = IndexStore(spark, scratch_path(spark, "index"))
    checkpoint = scratch_path(spark, "stream")

    def run():
        source = stream_files(spark, str(folder), files=5)
        stream_ingest(source, streamed, letters, 8, checkpoint, after_batch=top).awaitTermination()

    run()
    assert streamed.state().version == 5 and top.refreshed == 5

    batch = IndexStore(spark, scratch_path(spark, "index"))
    listing = spark.read.format("binaryFile").load(str(folder)).select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"),
        F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    ingest(batch, listing.select("path", "mtime", "size"),
           lambda fresh: letters(fresh.join(listing.select("path", "content"), "path")), str(folder), 8)
    assert live(streamed) == live(batch) and len(live(batch)) == 23
    path = str(folder / "f03.txt")
    data = b"content 3"
    want = hashlib.sha256(len(data).to_bytes(8, "little") + data).hexdigest()
    assert (path, len(data), want) in live(batch)

    def paths(df):
        return sorted((r.query_id, r["rank"], round(r.score, 6)) for r in df.collect())

    whole = search(queries, streamed.vectors(), streamed.manifest(), str(folder), limit=4, cutoff="none")
    assert paths(top.results(streamed)) == paths(whole)

    # Later files: one new, one with other content.
    (folder / "late.txt").write_bytes(b"late")
    (folder / "more.txt").write_bytes(b"content 3")
    run()
    assert len(live(streamed)) == 24  # more.txt holds known content
    whole = search(queries, streamed.vectors(), streamed.manifest(), str(folder), limit=4, cutoff="none")
    assert paths(top.results(streamed)) == paths(whole)


def test_batch_that_comes_again_is_passed_over(spark, folder):
    store = IndexStore(spark, scratch_path(spark, "index"))

    def run(checkpoint):
        stream_ingest(stream_files(spark, str(folder), files=50), store, letters, 8, checkpoint,
                      snapshot=False).awaitTermination()

    run(scratch_path(spark, "stream"))
    before = live(store), store.state().version
    # A lost checkpoint replays batch 0.
    run(scratch_path(spark, "stream"))
    assert (live(store), store.state().version) == before


def test_replaced_vectors_refresh_the_pools(spark):
    store = IndexStore(spark, scratch_path(spark, "index"))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    top = LiveTopK(queries, "/d", cutoff="none")

    def put(*rows):
        df = spark.createDataFrame(
            list(rows), "path string, mtime long, size long, content_hash string, embedding array<float>")
        before = store.state()
        ingest(store, df.drop("embedding"), lambda f: f.join(df.select("path", "embedding"), "path"), None, 2)
        top(store, before, store.state())
        return [(r.path, r.score) for r in top.results(store).orderBy("rank").collect()]

    assert put(("/d/a", 1, 1, "h1", [1.0, 0.0]), ("/d/b", 1, 1, "h2", [0.5, 0.0])) == [("/d/a", 1.0), ("/d/b", 0.5)]
    assert put(("/d/a", 2, 1, "h3", [0.25, 0.0])) == [("/d/b", 0.5), ("/d/a", 0.25)]
