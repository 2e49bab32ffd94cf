import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lumisift.operators import topk
from lumisift.operators.ann import ivf_add, ivf_build, knn_ivf, recall_at_k
from lumisift.operators.lsh import knn_lsh, lsh_build
from lumisift.operators.topk import Best, knn_exact, score_pairs
from lumisift.plans import blocks
from lumisift.plans.scratch import scratch_path


def unit(rng, count, dim=8):
    points = rng.normal(size=(count, dim))
    return (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)


def brute(queries, points, k):
    out = set()
    for q, query in queries.items():
        scored = sorted(
            ((-round(float(np.dot(query.astype(float), p.astype(float))), 10), i) for i, p in points.items()))
        out |= {(q, i, rank) for rank, (_, i) in enumerate(scored[:k], 1)}
    return out


def rows(df):
    return {(r.query_id, r.image_id, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_knn_equals_brute_force(spark, vectors, queries, monkeypatch, block_rows):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block_rows)
    if block_rows == 3:
        monkeypatch.setattr(topk, "_SCORES_AT_ONCE", 100)
        monkeypatch.setattr(topk, "_CANDIDATES", 5)
        monkeypatch.setattr(topk, "ONE_TASK_BYTES", 0)
    rng = np.random.default_rng(3)
    points = dict(enumerate(unit(rng, 300), 1))
    points.update({1000 + i: points[5] for i in range(40)})
    asked = dict(enumerate(unit(rng, 8)))
    found = knn_exact(queries(asked), vectors(points).repartition(5), 12)
    assert rows(found) == brute(asked, points, 12)


def test_copies_are_ordered_by_id(vectors, queries):
    found = knn_exact(queries({1: [1, 0]}), vectors({i: [1, 0] for i in range(100, 0, -1)}).repartition(4), 5)
    assert rows(found) == {(1, i, i) for i in range(1, 6)}


def test_other_dimensions_and_nan_match_nothing(spark, queries):
    bad = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0]), (3, [float("nan"), 0.0]), (4, None), (5, [0.0, 1.0])],
        "image_id long, embedding array<float>")
    assert rows(knn_exact(queries({7: [1, 0]}), bad, 9)) == {(7, 1, 1), (7, 5, 2)}


def test_empty_sides(vectors, queries):
    none = vectors({1: [1, 0]}).limit(0)
    assert knn_exact(queries({7: [1, 0]}), none, 3).count() == 0
    assert knn_exact(queries({7: [1, 0]}).limit(0), vectors({1: [1, 0]}), 3).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=1, max_size=7), min_size=1, max_size=6), st.integers(1, 5))
def test_best_keeps_the_best(parts, k):
    best = Best(1, k)
    best.enough = 4
    every, at = [], 0
    for part in parts:
        ids = np.arange(at, at + len(part))[::-1].copy()
        at += len(part)
        best.add(np.array([0]), ids, np.array([part], float))
        every += zip([-float(p) for p in part], ids.tolist())
    want = [(i, -s) for s, i in sorted(every)[:k]]
    assert list(zip(*(c.tolist() for c in best.cut()[1:]))) == want


def test_score_pairs(spark, vectors, queries):
    rng = np.random.default_rng(5)
    points, asked = dict(enumerate(unit(rng, 50), 1)), dict(enumerate(unit(rng, 3)))
    pairs = [(q, i) for i in points for q in asked if q == 0 or i == 7]
    got = score_pairs(spark.createDataFrame(pairs, "query_id long, image_id long"), queries(asked), vectors(points))
    found = {(r.query_id, r.image_id): r.score for r in got.collect()}
    assert set(found) == set(pairs)
    for (q, i), score in found.items():
        assert score == pytest.approx(float(asked[q].astype(float) @ points[i].astype(float)), abs=1e-9)


def test_ivf_over_all_cells_is_exact(spark, vectors, queries):
    rng = np.random.default_rng(6)
    points, asked = dict(enumerate(unit(rng, 400), 1)), dict(enumerate(unit(rng, 5)))
    index = ivf_build(vectors(points), scratch_path(spark, "ivf"), cells=6)
    assert index.vectors().count() == 400
    assert rows(knn_ivf(queries(asked), index, 10, 6)) == brute(asked, points, 10)
    late = dict(enumerate(unit(rng, 30), 5001))
    ivf_add(index, vectors(late))
    assert rows(knn_ivf(queries(asked), index, 10, 6)) == brute(asked, points | late, 10)
    points |= late
    few = knn_ivf(queries(asked), index, 10, 2)
    recall = recall_at_k(few, knn_exact(queries(asked), vectors(points), 10)).first()
    assert recall.expected == 50 and 0.2 < recall.recall <= 1.0


def test_ivf_replaces_a_vector_that_is_added_again(spark, vectors, queries):
    rng = np.random.default_rng(9)
    points, asked = dict(enumerate(unit(rng, 200), 1)), dict(enumerate(unit(rng, 4)))
    index = ivf_build(vectors(points), scratch_path(spark, "ivf"), cells=4)
    for _ in range(2):
        newer = dict(zip((1, 2, 3, 900), unit(rng, 4)))
        ivf_add(index, vectors(newer))
        points |= newer
        assert index.vectors().count() == len(points) == 201
        assert rows(knn_ivf(queries(asked), index, 201, 4)) == brute(asked, points, 201)
    plan = knn_ivf(queries(asked), index, 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_ivf_reads_only_the_cells_it_asks(spark, vectors, queries):
    centres = spark.createDataFrame([(c, [float(c == j) for j in range(4)]) for c in range(4)],
                                    "cell int, embedding array<float>")
    points = {i: [float(j == i % 4) for j in range(4)] for i in range(40)}
    index = ivf_build(vectors(points), scratch_path(spark, "ivf"), centres=centres)
    found = knn_ivf(queries({0: [0.1, 0.9, 0, 0]}), index, 40, 1)
    assert {r.image_id % 4 for r in found.collect()} == {1}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan


def test_hot_cell_is_written_by_several_tasks(spark, vectors, monkeypatch):
    from lumisift.operators import ann

    monkeypatch.setattr(ann, "FILE_ROWS", 50)
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cell int, embedding array<float>")
    points = {i: ([1, 0] if i % 10 else [0, 1]) for i in range(600)}
    index = ivf_build(vectors(points), scratch_path(spark, "ivf"), centres=centres)
    hot = index.vectors().where("cell = 0")
    assert hot.count() == 540
    assert len(hot.inputFiles()) > 1


def test_lsh_scores_are_exact_and_recall_is_reported(spark, vectors, queries):
    rng = np.random.default_rng(8)
    points, asked = dict(enumerate(unit(rng, 400), 1)), dict(enumerate(unit(rng, 5)))
    for q, query in asked.items():
        points[2000 + q] = query
    index = lsh_build(vectors(points), scratch_path(spark, "lsh"))
    found = knn_lsh(queries(asked), index, 10).collect()
    for row in found:
        want = float(asked[row.query_id].astype(float) @ points[row.image_id].astype(float))
        assert row.score == pytest.approx(want, abs=1e-9)
    # A vector shares every bucket with itself.
    assert {(r.query_id, r.image_id) for r in found if r["rank"] == 1} == {(q, 2000 + q) for q in asked}


# -- cells on two levels ------------------------------------------------------------

def test_more_cells_than_a_block(spark, vectors, queries, monkeypatch):
    """Cells beyond the bound of one level, which is small here; all of them give the exact result."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 12)
    rng = np.random.default_rng(11)
    points, asked = dict(enumerate(unit(rng, 500), 1)), dict(enumerate(unit(rng, 5)))
    index = ivf_build(vectors(points), scratch_path(spark, "ivf"), cells=60)
    cells = index.centres()
    assert index.on_two_levels() and cells.count() >= 60 and cells.select("cell").distinct().count() == cells.count()
    assert index.parents().count() <= 12
    assert index.vectors().count() == 500
    assert rows(knn_ivf(queries(asked), index, 10, cells.count())) == brute(asked, points, 10)
    late = dict(enumerate(unit(rng, 20), 490))
    ivf_add(index, vectors(late))
    points |= late
    assert rows(knn_ivf(queries(asked), index, 10, cells.count())) == brute(asked, points, 10)
    exact = knn_exact(queries(asked), vectors(points), 10)
    recall = recall_at_k(knn_ivf(queries(asked), index, 10, 40), exact).first().recall
    assert recall >= 0.8
    plan = knn_ivf(queries(asked), index, 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert "parent" in plan[plan.index("PartitionFilters"):] and "In(cell" in plan


def test_over_4096_cells(spark):
    from lumisift.operators.ann import fit_two_levels

    df = spark.range(30_000).selectExpr(
        "id AS image_id", "array(CAST(cos(id * 0.37) AS FLOAT), CAST(sin(id * 0.37) AS FLOAT), CAST(cos(id) AS FLOAT)) AS embedding")
    centres, parents = fit_two_levels(df, 5000, rounds=1, inner_rounds=1)
    assert centres.count() > 4096 and parents.count() <= 70
    assert centres.join(parents.select(parents.cell.alias("parent")), "parent", "left_anti").isEmpty()


def test_centres_move_to_the_means(spark, vectors):
    from lumisift.operators.ann import fit_centres

    rng = np.random.default_rng(12)
    points = np.r_[unit(rng, 50, 4) * 0.1 + [1, 0, 0, 0], unit(rng, 50, 4) * 0.1 + [0, 1, 0, 0]]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    got = fit_centres(vectors(dict(enumerate(points, 1))), 2, rounds=20).collect()
    means = [points[:50].mean(axis=0), points[50:].mean(axis=0)]
    near = sorted(max(float(np.dot(r.embedding, m / np.linalg.norm(m))) for m in means) for r in got)
    assert near[0] > 0.9999
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


# -- buckets ---------------------------------------------------------------------------

def test_lsh_looks_at_the_probed_buckets_once(spark, vectors, queries):
    rng = np.random.default_rng(13)
    points, asked = dict(enumerate(unit(rng, 600), 1)), dict(enumerate(unit(rng, 6)))
    index = lsh_build(vectors(points), scratch_path(spark, "lsh"), tables=3, planes=3)
    hashes = index.hashes()
    probes = hashes.probes(np.array([asked[q] for q in sorted(asked)], float), 5)
    buckets = hashes.buckets(np.floor(hashes.places(np.array([points[i] for i in sorted(points)], float))))
    found = knn_lsh(queries(asked), index, 600, probes=5).collect()
    want = {(q, i + 1) for q in asked for i in range(600) if any(buckets[i, t] in probes[q, t] for t in range(3))}
    assert {(r.query_id, r.image_id) for r in found} == want and len(found) == len(want) < 6 * 600


def test_nearer_buckets_come_first(spark, vectors):
    rng = np.random.default_rng(14)
    hashes = lsh_build(vectors({1: unit(rng, 1)[0]}), scratch_path(spark, "lsh"), tables=2, planes=2).hashes()
    point = unit(rng, 1).astype(float)
    place = hashes.places(point)[0]
    own, order = np.floor(place), hashes.probes(point, 9)[0]
    for t in range(2):
        cost = {}
        for a in range(-3, 4):
            for b in range(-3, 4):
                away = [max(0.0, o + m - x, x - (o + m + 1)) for o, m, x in zip(own[t], (a, b), place[t])]
                cost[int(hashes.buckets(own[t] + [a, b]))] = sum(d * d for d in away)
        assert [cost[int(b)] for b in order[t]] == pytest.approx(sorted(cost.values())[:9])


def test_lsh_reads_only_the_folders_it_asks(spark, vectors, queries):
    from lumisift.operators.lsh import lsh_add

    rng = np.random.default_rng(15)
    points, asked = dict(enumerate(unit(rng, 300), 1)), dict(enumerate(unit(rng, 2)))
    index = lsh_build(vectors(points), scratch_path(spark, "lsh"), folders=8)
    found = knn_lsh(queries(asked), index, 5, probes=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):]
    assert "folder" in filters and "table" in filters and "bucket" in plan[plan.index("PushedFilters"):]
    newer = dict(zip((1, 2, 900), unit(rng, 3)))
    lsh_add(index, vectors(newer))
    assert index.vectors().select("image_id").distinct().count() == 301
    mine = {r.image_id: r.score for r in knn_lsh(queries({7: newer[1]}), index, 400, probes=400).collect()}
    assert mine[1] == pytest.approx(1.0, abs=1e-6) and len(mine) <= 301
    assert knn_lsh(queries({7: [1.0, 0.0]}), index, 4).count() == 0


def test_hot_bucket_is_written_by_several_tasks(spark, vectors, queries, monkeypatch):
    from lumisift.operators import ann

    monkeypatch.setattr(ann, "FILE_ROWS", 50)
    points = {i: [1.0, 0.0] for i in range(400)}
    index = lsh_build(vectors(points), scratch_path(spark, "lsh"), tables=2, planes=2)
    assert len(index.vectors().where("table = 0").inputFiles()) > 1
    assert knn_lsh(queries({1: [1, 0]}), index, 400).count() == 400
