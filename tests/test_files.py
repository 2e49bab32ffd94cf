import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.catalog.files import QUERIES, png
from lumisift.functions.content import content_fingerprint, file_checksum
from lumisift.functions.paths import base_name, extension, filter_extensions, prefix_filter
from lumisift.operators.embed import image_tensor
from lumisift.plans.jobs import with_fingerprints
from lumisift.sources.files import (
    full_path, image_geometry, missing_files, pick_images, read_content, read_path_list, rejected_files, scan_files,
    scan_images, write_results,
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.JPG").write_bytes(b"a" * 10)
    (tmp_path / "sub" / "b.png").write_bytes(b"b" * 9000)
    (tmp_path / "c.txt").write_bytes(b"c")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / ".hid.jpg").write_bytes(b"h")
    (tmp_path / "_u.jpg").write_bytes(b"u")
    os.symlink(tmp_path / "a.JPG", tmp_path / "l.jpg")
    os.utime(tmp_path / "a.JPG", (1_700_000_000, 1_700_000_000))
    return tmp_path


def quick(data):
    return hashlib.sha256(len(data).to_bytes(8, "little") + data[:8192]).hexdigest()


def test_scan_and_fingerprint(spark, folder):
    listed = scan_files(spark, str(folder))
    rows = {os.path.relpath(r.path, folder): r for r in listed.collect()}
    assert set(rows) == {"a.JPG", "sub/b.png", "c.txt", "l.jpg"}
    assert rows["a.JPG"].mtime == 1_700_000_000 and rows["sub/b.png"].size == 9000
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan[plan.index("ReadSchema"):]
    hashed = {os.path.relpath(r.path, folder): r.content_hash for r in with_fingerprints(listed).collect()}
    assert hashed["sub/b.png"] == quick(b"b" * 9000)
    assert hashed["c.txt"] == quick(b"c") and hashed["a.JPG"] == quick(b"a" * 10)


def test_full_path(spark, folder, monkeypatch):
    for form in (str(folder), f"file://{folder}", f"{folder}/", f"file:{folder}"):
        assert full_path(spark, form) == str(folder)
    listed = scan_files(spark, f"file://{folder}")
    assert prefix_filter(listed, full_path(spark, f"file://{folder}")).count() == 4


def test_read_content(spark, folder):
    paths = spark.createDataFrame([(str(folder / "sub" / "b.png"),), ("/no/such/file",)], "path string")
    assert [len(r.content) for r in read_content(paths, head=100).collect()] == [100]
    assert [len(r.content) for r in read_content(paths, head=None).collect()] == [9000]
    uri = spark.createDataFrame([(f"file://{folder}/a.JPG",)], "path string")
    assert [r.content for r in read_content(uri).collect()] == [b"a" * 10]


def test_rejected_and_missing_files(spark, folder):
    paths = [str(folder / "c.txt"), str(folder / "empty.txt"), "/no/such/file", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rejected = {r.path: r.reason for r in rejected_files(df).collect()}
    assert set(rejected) == {"/no/such/file", None} and all(rejected.values())
    assert {r.path for r in missing_files(df).collect()} == {"/no/such/file", None}


def test_an_unreachable_store_is_no_empty_result(spark, monkeypatch):
    away = spark.createDataFrame([("nosuchscheme://host/a",)], "path string")
    with pytest.raises(Exception, match="nosuchscheme"):
        read_content(away).collect()


def test_file_systems_are_kept_per_host(monkeypatch):
    from lumisift.sources import files

    asked = []

    class Systems:
        LocalFileSystem = files.pafs.LocalFileSystem

        class FileSystem:
            @staticmethod
            def from_uri(uri):
                asked.append(uri)
                scheme, _, rest = uri.partition("://")
                return uri, (rest if scheme == "s3" else "/")

    monkeypatch.setattr(files, "pafs", Systems)
    opened = {}
    assert files._locate(opened, "s3a://one/a b%/c") == ("s3://one/", "one/a b%/c")
    assert files._locate(opened, "s3a://one/d") == ("s3://one/", "one/d")
    assert files._locate(opened, "hdfs://x:9000/d/e") == ("hdfs://x:9000/", "/d/e")
    assert files._locate(opened, "hdfs://y:9000/d") == ("hdfs://y:9000/", "/d")
    assert files._locate(opened, "/d/e") == ("file:///", "/d/e")
    assert len(asked) == 4


def test_a_failing_store_is_tried_again(monkeypatch):
    from lumisift.sources import files

    calls = []

    def shaky(value):
        calls.append(value)
        if len(calls) < 3:
            raise OSError("slow down")
        return value

    monkeypatch.setattr(files.time, "sleep", lambda _: None)
    assert files._tried(shaky, 5) == 5 and calls == [5, 5, 5]
    with pytest.raises(OSError, match="slow down"):
        calls.clear()
        files._tried(lambda: shaky(calls.clear()))


def test_fingerprint_of_columns(spark):
    data = [bytes([i % 256]) * n for i, n in enumerate((0, 1, 255, 8191, 8192, 8193, 70_000))]
    df = spark.createDataFrame([(d, len(d)) for d in data], "content binary, size long")
    got = df.select(content_fingerprint("content", "size").alias("f"), file_checksum("content").alias("c")).collect()
    assert [r.f for r in got] == [quick(d) for d in data]
    assert [r.c for r in got] == [hashlib.sha256(d).hexdigest() for d in data]


def test_paths(spark):
    df = spark.createDataFrame(
        [("/a/x.JPG",), ("/ab/y.jpeg",), ("/a/.jpg",), ("/a/z.tar.webp",), ("/a/jpg",), ("/a/b.d/q",)], "path string")
    ext = [r[0] for r in df.select(extension("path")).collect()]
    assert ext == ["jpg", "jpeg", "", "webp", "", ""]
    assert filter_extensions(df).count() == 3
    assert prefix_filter(df, "/a").count() == prefix_filter(df, "/a/").count() == 5
    assert df.select(base_name("path")).first()[0] == "x.JPG"
    assert df.select(base_name(F.lit("/a/b/"))).first()[0] == "b"


def test_prefix_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("/a/x",)], "path string").write.parquet(str(tmp_path / "t"))
    plan = prefix_filter(spark.read.parquet(str(tmp_path / "t")), "/a")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,/a/)" in plan


def test_images(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(png(6, 4, bytes([10, 20, 30]) * 24))
    (tmp_path / "bad.png").write_bytes(b"no image")
    good = scan_images(spark, str(tmp_path)).collect()
    assert [(r.path, r.width, r.height, bytes(r.data[:3])) for r in good] == [
        (str(tmp_path / "good.png"), 6, 4, bytes([30, 20, 10]))]
    bad = scan_images(spark, str(tmp_path), valid=False)
    assert [os.path.basename(r.path) for r in bad.collect()] == ["bad.png"]
    both = scan_images(spark, str(tmp_path)).unionByName(bad)
    assert sorted(r.aspect for r in image_geometry(both).collect()) == [1.5, 1.5]


def test_odd_names(spark, tmp_path):
    names = {"a [1].png", "{b}.png", "c%20d.png", "é+.png", "e*f?.png"}
    for name in names:
        (tmp_path / name).write_bytes(png(1, 1, bytes([1, 2, 3])))
    listed = scan_files(spark, str(tmp_path))
    for images in (scan_images(spark, str(tmp_path)), pick_images(spark, str(tmp_path), listed)):
        assert {os.path.basename(r.path) for r in images.collect()} == names


def test_many_images_are_picked_from_a_scan(spark, tmp_path, monkeypatch):
    from lumisift.sources import files

    for i in range(4):
        (tmp_path / f"{i}.png").write_bytes(png(1, 1, bytes([1, 2, 3])))
    monkeypatch.setattr(files, "NAMED_PATHS", 1)
    wanted = scan_files(spark, str(tmp_path)).where(~F.col("path").endswith("0.png"))
    assert pick_images(spark, str(tmp_path), wanted).count() == 3
    assert pick_images(spark, str(tmp_path), wanted.limit(0)).count() == 0


def test_vanished_images_are_left_out(spark, tmp_path, monkeypatch):
    from lumisift.sources import files

    for i in range(3):
        (tmp_path / f"{i}.png").write_bytes(png(1, 1, bytes([1, 2, 3])))
    listed = spark.createDataFrame(scan_files(spark, str(tmp_path)).collect())
    (tmp_path / "1.png").unlink()
    for most in (10, 1):
        monkeypatch.setattr(files, "NAMED_PATHS", most)
        assert pick_images(spark, str(tmp_path), listed).count() == 2


def test_path_list_and_results(spark, tmp_path):
    (tmp_path / "list.txt").write_text("/a b.jpg\n\n/c.jpg\n")
    assert [tuple(r) for r in read_path_list(spark, str(tmp_path / "list.txt")).collect()] == [
        (0.0, "/a b.jpg"), (0.0, "/c.jpg")]
    df = spark.createDataFrame([(1, 2, 0.25, "/b"), (1, 1, 0.5, "/a")], "query_id int, rank int, score double, path string")
    write_results(df, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["0.5000\t/a", "0.2500\t/b"]


def test_tensors_of_many_images_are_summed_up_in_batches(spark, tmp_path):
    rows = [(i, [((i + j) % 65) / 32 - 1.0 for j in range(64)], i % 3) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    levels = QUERIES["preprocess_images"](spark, str(tmp_path))
    # No expression walks through the numbers of a tensor one by one, and none becomes a row of pandas.
    plan = levels._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "MapInPandas" not in plan
    got = {r.image_id: r for r in levels.collect()}
    assert set(got) == {i + 1 for i in range(20) if i % 3}
    for i, embedding, _ in (row for row in rows if row[2]):
        level = [int((np.float32(x) + 1.0) * 127.5) for x in embedding]
        data = bytes(b for r, l in zip(level, reversed(level)) for b in (l, 255 - r, r))
        tensor = image_tensor(data, 4, 16, 3).astype(float)
        r = got[i + 1]
        assert (r.n, r.lowest, r.highest) == (150_528, round(tensor.min(), 4), round(tensor.max(), 4))
        assert r.mean == pytest.approx(tensor.mean(), abs=6e-5)


def test_tasks_list_the_folders_by_the_rules_of_the_file_source(spark, tmp_path):
    names = ["a/x.txt", "a/_h/y.txt", "a/.g/z", "a/_metadata/f", "a/_metadata/_f", "a/k=1/_p=2", "_common_metadata", "top",
             "b c/é+%20.txt", "b c/x._COPYING_", "e/f/g/h/i.txt", "[q]/w", "_k=v/q", "d._COPYING_/f"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty").touch()
    (tmp_path / "nothing").mkdir()
    os.symlink(tmp_path / "e", tmp_path / "link")
    os.symlink(tmp_path / "none", tmp_path / "broken")
    os.utime(tmp_path / "top", (1_234_567_890.9, 1_234_567_890.9))
    os.utime(tmp_path / "a" / "x.txt", (-1.5, -1.5))
    for root in (str(tmp_path), f"{tmp_path}/top", f"{tmp_path}/*", f"{tmp_path}/a/_h", f"{tmp_path}/nothing"):
        listed = scan_files(spark, root)
        # The driver holds parts of a table, not the files.
        assert not any(name.split("/")[-1] in {"x.txt", "top", "y.txt"} for name in listed.inputFiles())
        plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        plain = plain.selectExpr("regexp_replace(path, '^file:/*', '/')", "unix_timestamp(modificationTime)", "length")
        assert sorted(listed.collect()) == sorted(plain.collect())
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_files(spark, f"{tmp_path}/nowhere")


@pytest.mark.parametrize("head", [100, None])
def test_all_cores_read_the_files_of_a_short_list(spark, tmp_path, head):
    for i in range(40):
        (tmp_path / f"{i}.txt").write_text(str(i))
    listed = scan_files(spark, str(tmp_path)).coalesce(1)
    read = read_content(listed, head=head).withColumn("task", F.spark_partition_id())
    rows = read.collect()
    assert {(os.path.basename(r.path), bytes(r.content)) for r in rows} == {(f"{i}.txt", str(i).encode()) for i in range(40)}
    assert len({r.task for r in rows}) == spark.sparkContext.defaultParallelism
