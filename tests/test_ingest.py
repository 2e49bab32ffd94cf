import pytest
from pyspark.sql import functions as F

from lumisift.operators.checks import UNKNOWN_CHECKSUM, orphan_files, verify_checksums
from lumisift.operators.ingest import (
    detect_changed, detect_stale, full_reindex, ingest_counts, ingest_plan,
    remove_paths, skip_seen_content, upsert_manifest,
)
from lumisift.schema import MANIFEST

DISK = "path string, mtime long, size long, content_hash string"


@pytest.fixture
def manifest(spark):
    return spark.createDataFrame([
        (1, "/d/same.jpg", 10, 100, "h1", 1),
        (2, "/d/touched.jpg", 10, 100, "h2", 1),
        (3, "/d/changed.jpg", 10, 100, "h3", 1),
        (4, "/d/gone.jpg", 10, 100, "h4", 1),
        (5, "/dd/other.jpg", 10, 100, "h5", 1),
        (6, "", 10, 100, "", 1),
    ], MANIFEST)


@pytest.fixture
def disk(spark):
    return spark.createDataFrame([
        ("/d/same.jpg", 10, 100, "h1"),
        ("/d/touched.jpg", 11, 100, "h2"),
        ("/d/changed.jpg", 10, 101, "x3"),
        ("/d/new1.jpg", 10, 100, "n"),
        ("/d/new2.jpg", 10, 100, "n"),
        ("/d/moved.jpg", 10, 100, "h4"),
        ("/d/copy.jpg", 10, 100, "h5"),
    ], DISK)


def actions(df):
    return {r.path: r.action for r in df.collect()}


def names(df):
    return sorted(r.path.rsplit("/", 1)[-1].split(".")[0] for r in df.collect())


def test_changed_seen_stale(disk, manifest):
    changed = detect_changed(disk, manifest)
    assert names(changed) == ["changed", "copy", "moved", "new1", "new2", "touched"]
    assert names(skip_seen_content(changed, manifest)) == ["changed", "new1", "new2"]
    assert names(detect_stale(manifest, disk, "/d")) == ["gone"]


def test_plan(disk, manifest):
    plan = ingest_plan(disk, manifest, "/d")
    assert actions(plan) == {
        "/d/same.jpg": "unchanged", "/d/touched.jpg": "seen", "/d/changed.jpg": "changed",
        "/d/new1.jpg": "new", "/d/new2.jpg": "new", "/d/moved.jpg": "seen", "/d/copy.jpg": "seen",
        "/d/gone.jpg": "stale",
    }
    assert {r.action: r.files for r in ingest_counts(plan).collect()} == {
        "unchanged": 1, "seen": 3, "changed": 1, "new": 2, "stale": 1}


def test_plan_options(disk, manifest):
    assert actions(ingest_plan(disk, manifest, "/d", dedup_within_batch=True))["/d/new2.jpg"] == "seen"
    assert actions(ingest_plan(disk, manifest, "/d", evict_first=True))["/d/moved.jpg"] == "new"
    reindex = actions(ingest_plan(disk, manifest, "/d", update=False))
    assert "/d/gone.jpg" not in reindex and reindex["/d/same.jpg"] == "seen"
    fresh = actions(ingest_plan(disk, full_reindex(manifest), "/d", update=False))
    assert set(fresh.values()) == {"new"} and len(fresh) == 7


def test_empty_hash_is_never_seen(spark, manifest):
    files = spark.createDataFrame([("/d/odd.jpg", 1, 1, "")], DISK)
    assert skip_seen_content(files, manifest).count() == 1


def test_rename_takes_two_runs(spark, manifest):
    disk = spark.createDataFrame([("/d/renamed.jpg", 10, 100, "h4")], DISK)
    first = actions(ingest_plan(disk, manifest, "/d"))
    assert first["/d/renamed.jpg"] == "seen" and first["/d/gone.jpg"] == "stale"
    after = remove_paths(manifest, spark.createDataFrame([("/d/gone.jpg",)], "path string"))
    assert actions(ingest_plan(disk, after, "/d"))["/d/renamed.jpg"] == "new"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), DISK + ", vec_version long")


def test_upsert_into_nothing_and_replace(spark):
    empty = spark.createDataFrame([], MANIFEST)
    one = upsert_manifest(empty, batch(spark, ("/a/b.jpg", 100, 200, "h1", 1)))
    assert [tuple(r) for r in one.collect()] == [(1, "/a/b.jpg", 100, 200, "h1", 1)]
    two = upsert_manifest(one, batch(spark, ("/a/b.jpg", 999, 300, "h2", 2), ("/a/a.jpg", 1, 1, "h3", 2)))
    assert sorted(map(tuple, two.collect())) == [
        (1, "/a/b.jpg", 999, 300, "h2", 2), (2, "/a/a.jpg", 1, 1, "h3", 2)]


def test_many_rows(spark):
    rows = [(f"/img/{i}.jpg", i, 10 * i, f"h{i}", 1) for i in range(200)]
    got = upsert_manifest(spark.createDataFrame([], MANIFEST), batch(spark, *rows)).collect()
    assert sorted(r.image_id for r in got) == list(range(1, 201))
    by_path = sorted(r.path for r in got)
    assert [r.path for r in sorted(got, key=lambda r: r.image_id)] == by_path


def test_removed_ids_are_not_used_again(spark, manifest):
    gone = spark.createDataFrame([("/dd/other.jpg",), ("/nowhere",)], "path string")
    removed = remove_paths(manifest, gone)
    assert removed.count() == manifest.count()
    row = removed.where("image_id = 5").first()
    assert (row.path, row.content_hash, row.size) == ("", "", 100)
    back = upsert_manifest(removed, batch(spark, ("/dd/other.jpg", 1, 1, "h5", 2)))
    assert back.where(F.col("path") == "/dd/other.jpg").first().image_id == 7



def test_checksums(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("old", "9")], "filename string, sha256 string")
    expected = spark.createDataFrame(
        [("a", "1"), ("b", "x"), ("c", UNKNOWN_CHECKSUM), ("d", "4"), ("e", UNKNOWN_CHECKSUM)],
        "filename string, sha256 string")
    got = {r.filename: r.status for r in verify_checksums(files, expected).collect()}
    assert got == {"a": "ok", "b": "mismatch", "c": "unverified", "d": "missing", "e": "missing"}
    assert [r.filename for r in orphan_files(files, expected).collect()] == ["old"]


def test_removed_rows_stay_removed(spark):
    rows = [(1, "/a", "h1"), (2, "", ""), (3, "", ""), (4, "/b", "h4")]
    manifest = spark.createDataFrame(rows, "image_id long, path string, content_hash string")
    gone = spark.createDataFrame([("/b",), ("",), ("/c",)], "path string")
    got = {r.image_id: r.path for r in remove_paths(manifest, gone).collect()}
    assert got == {1: "/a", 2: "", 3: "", 4: ""}
