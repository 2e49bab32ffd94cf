import os

import pytest
from pyspark.sql import functions as F, types as T

from lumisift.functions.vectors import l2_normalize
from lumisift.plans.jobs import ingest
from lumisift.plans.scratch import scratch_path
from lumisift.schema import DISK, MANIFEST, VECTORS, require, small_table
from lumisift.sources.store import IndexStore


@pytest.fixture
def store(spark):
    return IndexStore(spark, scratch_path(spark, "index"))


def rows(spark, *values):
    return small_table(spark, [dict(zip(MANIFEST.fieldNames(), v)) for v in values], MANIFEST)


def test_new_index_is_empty(store):
    assert store.manifest().count() == 0
    assert store.vectors().count() == 0
    assert store.state().version == 0


def test_round_trip(spark, store):
    value = (1, "/a/b.jpg", 100, 200, "h1", 1)
    store.write_manifest(rows(spark, value))
    assert [tuple(r) for r in IndexStore(spark, store.root).manifest().collect()] == [value]


def test_reading_writes_nothing(store):
    assert store.vectors().count() == 0 and store.missing_vectors(store.vectors()).count() == 0
    assert not os.path.exists(store.root)


def test_other_schema_is_an_error(spark, store):
    with pytest.raises(ValueError, match="expected bigint"):
        store.write_manifest(rows(spark, (1, "/a", 1, 1, "h", 1)).withColumn("size", F.lit("big")))
    with pytest.raises(ValueError):
        require(spark.range(1), VECTORS)


def test_vectors_append_and_read(spark, store, vectors):
    one = [i * 0.001 for i in range(768)]
    store.append_vectors(vectors({1: one}))
    store.append_vectors(vectors({2: [float(i) for i in range(768)], 3: [-float(i) for i in range(768)]}))
    got = {r.image_id: r.embedding for r in store.vectors().collect()}
    assert got[1] == pytest.approx(one) and got[2][767] == 767.0 and got[3][767] == -767.0
    ids = spark.createDataFrame([(2,), (9,)], "image_id long")
    assert [r.image_id for r in store.read_vectors(ids).collect()] == [2]
    assert [r.image_id for r in store.missing_vectors(ids).collect()] == [9]


def test_uncommitted_version_is_invisible_and_overwritten(spark, store, vectors):
    first = store.write_manifest(rows(spark, (1, "/a", 1, 1, "h1", 1)), vectors({1: [1, 0]}))
    # A run that died after writing its folders, before its commit row.
    rows(spark, (2, "/lost", 1, 1, "h2", 2)).write.parquet(f"{store.root}/manifest/version=2/run=lost")
    vectors({2: [0, 1]}).write.parquet(f"{store.root}/vectors/version=2/run=lost")
    assert [r.path for r in store.manifest().collect()] == ["/a"]
    assert store.vectors().count() == 1
    assert store.state() == first
    store.stage(rows(spark, (2, "/b", 1, 1, "h3", 2)), first)
    store.commit(first, vectors({2: [1, 1]}))
    assert sorted(r.path for r in store.manifest().collect()) == ["/a", "/b"]
    assert sorted(r.embedding for r in store.vectors().collect()) == [[1.0, 0.0], [1.0, 1.0]]


def test_leftovers_do_not_join_a_later_version(spark, store, vectors):
    first = store.write_manifest(rows(spark, (1, "/a", 1, 1, "h1", 1)), vectors({1: [1, 0]}))
    # A run died after its vectors; the next one has none, and the one after has only vectors.
    vectors({2: [0, 1]}).write.parquet(f"{store.root}/vectors/version=2/run=lost")
    store.stage(rows(spark, (1, "/b", 2, 1, "h1", 1)), first)
    store.commit(first)
    assert [r.path for r in store.manifest().collect()] == ["/b"]
    assert [r.image_id for r in store.vectors().collect()] == [1]
    rows(spark, (9, "/lost", 1, 1, "h9", 3)).write.parquet(f"{store.root}/manifest/version=3/run=lost")
    store.append_vectors(vectors({3: [1, 1]}))
    assert [r.path for r in store.manifest().collect()] == ["/b"]
    assert sorted(r.image_id for r in store.vectors().collect()) == [1, 3]


def listing(spark, *rows):
    schema = T.StructType([*DISK.fields, T.StructField("content_hash", T.StringType())])
    return small_table(spark, [dict(zip(schema.fieldNames(), r)) for r in rows], schema)


def by_hash(calls):
    """An embedder that puts a number taken from the fingerprint into a vector."""

    def embedder(files):
        calls.append(files)
        number = F.length("content_hash").cast("float")
        return files.withColumn("embedding", l2_normalize(F.array(number, F.lit(1.0).cast("float"))))

    return embedder


def live(store):
    return {r.path: (r.image_id, r.content_hash) for r in store.manifest().where("path <> ''").collect()}


def test_ingest_runs(spark, store):
    embedder = by_hash([])
    first = ingest(store, listing(spark, ("/d/a", 1, 1, "h"), ("/d/b", 1, 1, "hh")), embedder, "/d", 2)
    assert (first.indexed, first.removed, first.state.version) == (2, 0, 1)
    again = ingest(store, listing(spark, ("/d/a", 1, 1, "h"), ("/d/b", 1, 1, "hh")), embedder, "/d", 2)
    assert (again.indexed, again.removed, again.state.version) == (0, 0, 1)
    # a changes, b goes, c and d come with equal content.
    third = ingest(store, listing(
        spark, ("/d/a", 2, 2, "hhh"), ("/d/c", 1, 1, "hhhh"), ("/d/d", 1, 1, "hhhh")), embedder, "/d", 2)
    assert (third.indexed, third.removed) == (3, 1)
    assert live(store) == {"/d/a": (1, "hhh"), "/d/c": (3, "hhhh"), "/d/d": (4, "hhhh")}
    assert store.state().max_image_id == 4 and store.state().voided == 1
    current = {r.image_id: r.embedding[0] / r.embedding[1] for r in store.vectors().collect()}
    assert current[1] == pytest.approx(3.0)
    assert sorted(current) == [1, 2, 3, 4]
    assert live_at(store, 1) == {"/d/a", "/d/b"}

    folded = store.compact(vectors=False)
    assert (folded.version, folded.base, folded.voided) == (3, 3, 1)
    assert live(store) == {"/d/a": (1, "hhh"), "/d/c": (3, "hhhh"), "/d/d": (4, "hhhh")}
    assert {r.image_id: r.embedding for r in store.vectors().collect()}[1][0] == pytest.approx(
        3 / 10 ** 0.5)

    compact = store.compact()
    assert compact.voided == 0 and store.manifest().count() == 4
    assert sorted(r.image_id for r in store.vectors().collect()) == [1, 3, 4]
    back = ingest(store, listing(spark, ("/d/a", 2, 2, "hhh"), ("/d/c", 1, 1, "hhhh"), ("/d/d", 1, 1, "hhhh"),
                                 ("/d/b", 1, 1, "hh")), embedder, "/d", 2)
    assert back.indexed == 1 and live(store)["/d/b"] == (5, "hh")


def live_at(store, version):
    return {r.path for r in store.manifest(version).where("path <> ''").collect()}


def test_touched_file(spark, store):
    embedder = by_hash([])
    ingest(store, listing(spark, ("/d/a", 1, 1, "h")), embedder, "/d", 2)
    touched = listing(spark, ("/d/a", 5, 1, "h"))
    assert ingest(store, touched, embedder, "/d", 2).state.version == 1
    assert store.manifest().first().mtime == 1
    ingest(store, touched, embedder, "/d", 2, refresh_mtime=True)
    assert store.manifest().first().mtime == 5
    assert ingest(store, touched, embedder, "/d", 2, refresh_mtime=True).state.version == 2


def test_ingest_options(spark, store):
    embedder = by_hash([])
    files = listing(spark, ("/d/a", 1, 1, "h"), ("/d/b", 1, 1, "h"))
    assert ingest(store, files, embedder, "/d", 2, dedup_within_batch=True).indexed == 1
    moved = listing(spark, ("/d/c", 1, 1, "h"))
    assert ingest(store, moved, embedder, "/d", 2, evict_first=True).indexed == 1
    assert set(live(store)) == {"/d/c"}


def test_bad_vectors_are_not_indexed(spark, store):
    def embedder(files):
        short = F.array(F.lit(1.0).cast("float"))
        good = F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float"))
        return files.withColumn("embedding", F.when(F.col("path").endswith("bad"), short).otherwise(good))

    run = ingest(store, listing(spark, ("/d/bad", 1, 1, "h"), ("/d/good", 1, 1, "hh")), embedder, "/d", 2)
    assert run.indexed == 1 and set(live(store)) == {"/d/good"}


def test_other_directories_survive(spark, store):
    embedder = by_hash([])
    ingest(store, listing(spark, ("/d/a", 1, 1, "h"), ("/dd/b", 1, 1, "hh")), embedder, None, 2)
    run = ingest(store, listing(spark), embedder, "/d", 2)
    assert run.removed == 1 and set(live(store)) == {"/dd/b"}


def test_reset(spark, store):
    embedder = by_hash([])
    ingest(store, listing(spark, ("/d/a", 1, 1, "h"), ("/e/b", 1, 1, "hh")), embedder, None, 2)
    store.reset()
    assert store.manifest().count() == 0 and store.vectors().count() == 0
    run = ingest(store, listing(spark, ("/d/a", 1, 1, "h")), embedder, "/d", 2, update=False)
    assert run.indexed == 1 and live(store) == {"/d/a": (1, "h")}


def test_ingest_images(spark, store, tmp_path):
    import numpy as np

    from lumisift.catalog.files import png
    from lumisift.operators.search import search
    from lumisift.plans.jobs import ingest_images

    red, blue = bytes([255, 0, 0]) * 24, bytes([0, 0, 255]) * 24
    (tmp_path / "sub").mkdir()
    (tmp_path / "red.png").write_bytes(png(6, 4, red))
    (tmp_path / "sub" / "blue [1].PNG").write_bytes(png(6, 4, blue))
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "note.txt").write_bytes(b"text")

    def model():
        return lambda pixels: pixels.mean(axis=(2, 3)) + 1.0

    first = ingest_images(store, str(tmp_path), model, 3)
    assert first.indexed == 2 and {p.rsplit("/", 1)[1] for p in live(store)} == {"red.png", "blue [1].PNG"}
    assert ingest_images(store, str(tmp_path), model, 3).state.version == first.state.version
    (tmp_path / "red.png").unlink()
    (tmp_path / "{dark}.png").write_bytes(png(6, 4, bytes([200, 10, 0]) * 24))
    second = ingest_images(store, f"file://{tmp_path}", model, 3)
    assert (second.indexed, second.removed) == (1, 1)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    got = search(asked, store.vectors(), store.manifest(), str(tmp_path), cutoff=0.5).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["{dark}.png"]
    assert np.isclose(got[0].score, 200 / np.hypot(200, 10), atol=1e-3)
    (tmp_path / "{dark}.png").write_bytes(b"")
    assert ingest_images(store, str(tmp_path), model, 3).removed == 0
    (tmp_path / "{dark}.png").unlink()
    assert ingest_images(store, str(tmp_path), model, 3).removed == 1


def test_a_committed_version_is_not_written_again(spark, store, vectors):
    before = store.state()
    store.append_vectors(vectors({1: [1.0, 0.0]}))
    empty = store.manifest().limit(0)
    for step in (lambda: store.stage(empty, before), lambda: store.commit(before, vectors({1: [0.0, 1.0]}))):
        with pytest.raises(ValueError, match="the index is at 1"):
            step()
    assert [list(r.embedding) for r in store.vectors().collect()] == [[1.0, 0.0]]


def test_of_two_runs_one_commits(spark, store, vectors):
    """Both stage the same version; the loser stops, and neither its rows nor its vectors count."""
    other = IndexStore(spark, store.root)
    first = store.write_manifest(rows(spark, (1, "/a", 1, 1, "h1", 1)), vectors({1: [1, 0]}))
    store.stage(rows(spark, (2, "/mine", 1, 1, "h2", 2)), first)
    other.stage(rows(spark, (2, "/theirs", 1, 1, "h3", 2)), first)
    won = other.commit(first, vectors({2: [0, 1]}))
    # As if this one had looked for the newest version before the other commit.
    store._require_next = lambda state: None
    with pytest.raises(ValueError, match="another run has committed it"):
        store.commit(first, vectors({2: [7, 7]}))
    del store._require_next
    assert sorted(r.path for r in store.manifest().collect()) == ["/a", "/theirs"]
    assert sorted(r.embedding for r in store.vectors().collect()) == [[0.0, 1.0], [1.0, 0.0]]
    assert store.state() == won == other.state()
    # The loser starts again from there.
    store.stage(rows(spark, (3, "/mine", 1, 1, "h2", 3)), won)
    store.commit(won, vectors({3: [7, 7]}))
    assert sorted(r.path for r in other.manifest().collect()) == ["/a", "/mine", "/theirs"]


@pytest.mark.parametrize("few", [20_000, 0])
def test_void_vectors_are_left_out(spark, store, vectors, monkeypatch, few):
    from lumisift.sources import store as stores

    monkeypatch.setattr(stores, "FEW_VOIDS", few)
    points = {i: [float(i), 0.0] for i in (1, 63, 64, 65, 127, 128, 500)}
    state = store.write_manifest(rows(spark, *((i, f"/{i}", 1, 1, f"h{i}", 1) for i in points)), vectors(points))
    for step, ids in enumerate([(1, 63, 64), (63, 500, 127)], 1):
        newer = {i: [float(i), float(step)] for i in ids}
        staged = rows(spark, *((i, f"/{i}", 1, 1, f"g{step}", step + 1) for i in ids)).withColumn("voids", F.lit(True))
        store.stage(staged, state)
        state = store.commit(state, vectors(newer), voided=len(ids))
        points |= newer
        found = store.vectors()
        assert sorted((r.image_id, r.embedding) for r in found.collect()) == sorted(points.items())
    assert ("Join" in found._jdf.queryExecution().executedPlan().toString()) == (few == 0)
    assert store.vectors(1).count() == 7
    kept = store.compact()
    assert kept.voided == 0 and sorted((r.image_id, r.embedding) for r in store.vectors().collect()) == sorted(points.items())
