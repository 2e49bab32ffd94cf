import pytest
from pyspark.sql import functions as F

from lumisift.plans import running, size, skew
from lumisift.plans.running import dense_ids, in_ranges, running_totals
from lumisift.plans.scratch import scratch_root
from lumisift.plans.skew import group_join, lookup_join


def test_scratch_root_is_the_sessions(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.fixture(params=["small", "large"])
def limits(request, monkeypatch):
    """Run as for small inputs, and as for large ones."""
    if request.param == "large":
        monkeypatch.setattr(running, "ONE_TASK_BYTES", 0)
        monkeypatch.setattr(skew, "ONE_TASK_BYTES", 0)


def test_running_totals(spark, limits):
    rows = [(g, float(x), x % 7 + 1) for g in ("a", "b", "hot") for x in range(5 if g != "hot" else 400)]
    df = spark.createDataFrame(rows, "g string, x double, n long").repartition(7)
    ranged = in_ranges(df, ["g"], "x")
    got = running_totals(ranged, ["g"], "x", {"upto": F.col("n")}, following="next").collect()
    assert len(got) == len(rows)
    by = {(r.g, r.x): r for r in got}
    for g in ("a", "b", "hot"):
        mine = sorted(r for r in rows if r[0] == g)
        total = 0
        for i, (_, x, n) in enumerate(mine):
            total += n
            assert by[g, x].upto == total
            assert by[g, x].next == (mine[i + 1][1] if i + 1 < len(mine) else None)
            assert by[g, x].n == n


def test_dense_ids(spark, limits):
    df = spark.createDataFrame([(f"p{i:04d}",) for i in range(1000)], "path string").repartition(9)
    got = {r.path: r.image_id for r in dense_ids(df, "path", start=5).collect()}
    assert got == {f"p{i:04d}": i + 5 for i in range(1000)}
    assert dense_ids(df.limit(0), "path", start=5).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_lookup_join_equals_plain_join(spark, limits, how):
    left = [(i, "hot" if i % 3 else f"k{i % 2000}") for i in range(6000)] + [(-1, None), (-2, "gone")]
    right = [(f"k{i}", i) for i in range(0, 2000, 2)] + [("hot", -5)]
    a = spark.createDataFrame(left, "id long, k string")
    b = spark.createDataFrame(right, "k string, v long")
    want = sorted(map(tuple, a.join(b, "k", how).select("id", *(["v"] if how in ("inner", "left") else [])).collect()), key=repr)
    found = lookup_join(a, b, "k", how)
    got = sorted(map(tuple, found.select("id", *(["v"] if how in ("inner", "left") else [])).collect()), key=repr)
    assert got == want


def test_group_join(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    groups = df.groupBy("g").agg(F.max("id").alias("top"))
    got = group_join(df, groups, ["g"], "id")
    assert got.count() == 1000
    assert {(r.g, r.top) for r in got.select("g", "top").distinct().collect()} == {(0, 999), (1, 997), (2, 998)}


def test_spread_moves_small_inputs_only(spark, tmp_path, monkeypatch):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert size.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(size, "SPLIT_BYTES", 1)
    assert size.spread(df) is df
