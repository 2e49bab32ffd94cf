import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.functions.vectors import (
    dot, l2_normalize, noise_floor, rejected_vectors, valid_vectors,
)
from lumisift.operators import reduce as R
from lumisift.plans import blocks


def test_normalize_keeps_tiny_vectors(vectors):
    df = vectors({1: [3, 4], 2: [0, 0], 3: [1e-7, 0]})
    got = {r.image_id: r.v for r in df.select("image_id", l2_normalize("embedding").alias("v")).collect()}
    assert got[1] == pytest.approx([0.6, 0.8])
    assert got[2] == [0, 0]
    assert got[3] == pytest.approx([1e-7, 0])


def test_dot_and_noise_floor(vectors):
    df = vectors({1: [1, 2, 3]})
    assert df.select(dot("embedding", "embedding")).first()[0] == 14
    assert noise_floor(768) == pytest.approx(0.10825, abs=1e-5)
    assert df.select(noise_floor(F.lit(64))).first()[0] == pytest.approx(0.375)


def test_valid_vectors(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, float("nan")]), (4, None), (5, [1.0, None])],
        "image_id long, embedding array<float>")
    assert [r.image_id for r in valid_vectors(df, 2).collect()] == [1]
    assert sorted(r.image_id for r in rejected_vectors(df, 2).collect()) == [2, 3, 4, 5]


def test_mean_pool_and_softmax(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 3, i, [float(x) for x in rng.normal(size=5)], float(rng.normal() * 400)) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, image_id long, embedding array<float>, score double")
    means = {r.g: r.embedding for r in R.mean_pool(df, ["g"]).collect()}
    weights = {r.image_id: r.weight for r in R.softmax_scores(df, "g").collect()}
    for g in range(3):
        mine = [r for r in rows if r[0] == g]
        want = np.mean(np.array([r[2] for r in mine], np.float32).astype(float), axis=0)
        assert means[g] == pytest.approx(list(want))
        scores = np.array([r[3] for r in mine])
        soft = np.exp(scores - scores.max())
        assert [weights[r[1]] for r in mine] == pytest.approx(list(soft / soft.sum()))


@pytest.mark.parametrize("block_rows", [4096, 2])
def test_linear_project(spark, vectors, monkeypatch, block_rows):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(2)
    points = {i: rng.normal(size=3).astype(np.float32) for i in range(20)}
    w, b = rng.normal(size=(5, 3)), rng.normal(size=5)
    weights = spark.createDataFrame(
        [(c, [float(x) for x in w[c]], float(b[c])) for c in range(5)], "col int, w array<double>, b double")
    got = R.linear_project(vectors(points), weights, 2.0, 0.5).collect()
    assert len(got) == 20
    for row in got:
        assert row.projected == pytest.approx(list(2.0 * points[row.image_id].astype(float) @ w.T + 0.5 * b))


def test_embedding_lookup(spark):
    table = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "idx long, embedding array<float>")
    lists = [(k, [0, 0, -1, k % 10] + ([99] if k == 3 else [])) for k in range(300)]
    got = R.embedding_lookup(spark.createDataFrame(lists, "key long, ids array<long>"), table).collect()
    assert len(got) == 300
    for row in got:
        want = [[0.0], [0.0], [9.0], [float(row.key % 10)]] + ([None] if row.key == 3 else [])
        assert row.rows == want


def test_summarize_runs(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "ms double")
    assert tuple(R.summarize_runs(df, "ms").first()) == (1.0, 3.0, 6.0)
    assert math.isclose(R.summarize_runs(df, "ms").first()["mean"], 3.0)


def test_lookup_keeps_empty_lists(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "idx long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1, 0, 5]), (2, []), (3, None)], "key long, ids array<long>")
    got = {r.key: r.rows for r in R.embedding_lookup(asked, table).collect()}
    assert got == {1: [[2.0], [1.0], None], 2: [], 3: []}
