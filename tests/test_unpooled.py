"""Top-k in one scan for any number of queries, and searches whose cutoff sees every score."""

import numpy as np
import pytest

from lumisift.operators import topk, unpooled
from lumisift.operators.search import search
from lumisift.operators.topk import as_blocks, knn_exact, scan_all, with_bars
from lumisift.operators.unpooled import BINS, all_thresholds, judged
from lumisift.plans import blocks, size
from lumisift.plans.scratch import materialize


def unit(rng, count, dim=8):
    points = rng.normal(size=(count, dim))
    return (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)


def scores_of(query, points):
    return {i: round(float(query.astype(float) @ p.astype(float)), 10) for i, p in points.items()}


def otsu(values, floor):
    """Every split of the sorted scores, one after the other."""
    values = sorted(v for v in values if v >= floor)
    if len(values) < 3:
        return floor
    best, threshold = 0.0, values[0]
    for at in range(1, len(values)):
        low, high = values[:at], values[at:]
        if low[-1] < high[0]:
            gap = sum(low) / len(low) - sum(high) / len(high)
            spread = len(low) * len(high) * gap * gap
            if spread > best * (1 + 1e-12):
                best, threshold = spread, (low[-1] + high[0]) / 2
    return max(threshold, floor)


@pytest.fixture
def stored(spark, vectors):
    """Vectors in a table, and their points."""
    points = dict(enumerate(unit(np.random.default_rng(2), 1200), 1))
    points.update({5000 + i: points[5] for i in range(30)})
    return materialize(vectors(points).repartition(6), "vectors"), points


def ranks(df):
    return {(r.query_id, r.image_id, r["rank"]) for r in df.collect()}


def best_of(asked, points, k):
    out = set()
    for q, query in asked.items():
        order = sorted((-s, i) for i, s in scores_of(query, points).items())
        out |= {(q, i, n) for n, (_, i) in enumerate(order[:k], 1)}
    return out


@pytest.fixture(params=[4096, 3])
def block_rows(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", request.param)
    return request.param


def test_bars_change_no_result(spark, queries, stored, block_rows, monkeypatch):
    monkeypatch.setattr(size, "SPLIT_BYTES", size.estimated_bytes(stored[0]) // 24)
    monkeypatch.setattr(topk, "SLAB_ROWS", 100)
    asked = dict(enumerate(unit(np.random.default_rng(3), 8)))
    assert ranks(knn_exact(queries(asked), stored[0], 40)) == best_of(asked, stored[1], 40)


def test_many_blocks_are_one_scan(spark, queries, stored, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 3)
    asked = as_blocks(queries(dict(enumerate(unit(np.random.default_rng(3), 8)))))
    assert asked.first is None and asked.table.select("_block").distinct().count() == 3
    found = knn_exact(asked, stored[0], 4)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    # What goes out with the tasks are names of files, no vectors.
    walk = asked.walk()
    assert walk.only is None and all(isinstance(name, str) for name in walk.files)


def test_bars_bound_what_leaves_the_scan(spark, queries, stored, block_rows, monkeypatch):
    tasks, k = 24, 5
    vectors, points = stored[0].repartition(tasks), stored[1]
    asked = as_blocks(queries(dict(enumerate(unit(np.random.default_rng(4), 6)))))
    monkeypatch.setattr(size, "SPLIT_BYTES", size.estimated_bytes(vectors) // tasks)
    without = scan_all(vectors, asked, k, "query_id").count()
    assert without == 6 * k * tasks
    barred = with_bars(asked, vectors, k, "query_id")
    bars = {r.query_id: r.bar for r in barred.table.collect()}
    with_them = scan_all(vectors, barred, k, "query_id").count()
    # Every 4th task was searched for the bars, so about four times k rows of a query pass them.
    assert 6 * k <= with_them < 6 * k * 8
    for q, bar in bars.items():
        reach = sorted((r.score for r in scan_all(vectors, asked, k, "query_id").where(f"query_id = {q}").collect()), reverse=True)
        assert bar <= reach[k - 1] + 1e-9


def test_only_some_splits_are_searched_for_bars(spark, queries, stored):
    asked = as_blocks(queries({1: [1.0] * 8}))
    assert scan_all(stored[0].repartition(24), asked, 3, "query_id", every=4).count() == 3 * 6


@pytest.mark.parametrize("lengths", [(5000, 10), (10, 5000)])
def test_dimension_is_the_commonest_of_all(spark, lengths):
    rows = [(i, [1.0]) for i in range(lengths[0])] + [(10_000 + i, [1.0, 0.0]) for i in range(lengths[1])]
    asked = as_blocks(spark.createDataFrame(rows, "query_id long, embedding array<float>"))
    assert asked.dim == (1 if lengths[0] > lengths[1] else 2)


# -- thresholds -------------------------------------------------------------------

def by_bins(values, floor):
    edges, opened, rounds = np.linspace(floor, max(1, floor + 1e-6), BINS), np.ones(BINS, int), 0
    while True:
        rounds += 1
        place = np.searchsorted(edges, values, side="right") - 1
        kept, place = values[place >= 0], place[place >= 0]
        names = np.unique(place)
        facts = [np.array([f(kept[place == n]) for n in names], float) for f in (len, np.sum, np.min, np.max)]
        threshold, edges, opened = judged(2 * names + opened[names], *facts, floor) if len(names) else (floor, None, None)
        if threshold is not None:
            return threshold, rounds
        edges, opened = np.array(edges), np.array(opened)
        assert rounds < 8


@pytest.mark.parametrize("count", [0, 1, 3, 40, 700])
def test_bins_find_the_split(count, monkeypatch):
    rng = np.random.default_rng(count)
    for bins in (8, 512):
        monkeypatch.setattr(unpooled, "BINS", bins)
        for values in (rng.normal(0, 0.2, count), rng.random(count) * 5, rng.choice([0.2, 0.3, 0.9], count),
                       np.r_[rng.normal(0.2, 0.05, count), rng.normal(0.8, 0.01, count // 5)], np.full(count, 0.5)):
            values = np.round(values, 10)
            assert by_bins(values, 0.125)[0] == pytest.approx(otsu(values.tolist(), 0.125), abs=1e-12)


def test_bins_need_few_scans():
    values = np.round(np.random.default_rng(0).normal(0, 0.2, 200_000), 10)
    assert by_bins(values, 0.1)[1] <= 3


def test_thresholds_of_all_scores(spark, queries, stored, block_rows, monkeypatch):
    monkeypatch.setattr(unpooled, "BINS", 16)
    monkeypatch.setattr(unpooled, "HELD_BINS", 50)
    monkeypatch.setattr(topk, "SLAB_ROWS", 100)
    asked = dict(enumerate(unit(np.random.default_rng(5), 7)))
    asked[7] = np.zeros(8, np.float32)
    got = all_thresholds(stored[0], as_blocks(queries(asked)), 0.2)
    got = {r.query_id: r.threshold for r in got.collect()}
    assert got == pytest.approx({q: otsu(scores_of(v, stored[1]).values(), 0.2) for q, v in asked.items()}, abs=1e-9)


@pytest.mark.parametrize("limit", [0, 7])
@pytest.mark.parametrize("cutoff", ["auto", "none", 0.3])
def test_search_of_everything(spark, queries, stored, block_rows, limit, cutoff):
    vectors, points = stored
    asked = dict(enumerate(unit(np.random.default_rng(6), 4)))
    paths = {i: "" if i % 11 == 0 else f"/a/{i}.jpg" if i % 2 else f"/ab/{i}.jpg" for i in points}
    manifest = spark.createDataFrame(list(paths.items()), "image_id long, path string")
    got = search(queries(asked), vectors, manifest, "/a", limit, cutoff, sigmas=0.5, pool="all").collect()
    want = set()
    for q, query in asked.items():
        inside = {i: s for i, s in scores_of(query, points).items() if paths[i].startswith("/a/")}
        bar = otsu(inside.values(), 0.5 / 8**0.5) if cutoff == "auto" else 0.0 if cutoff == "none" else cutoff
        order = sorted((-s, i) for i, s in inside.items() if s >= bar)
        want |= {(q, n, i, paths[i]) for n, (_, i) in enumerate(order[:limit or None], 1)}
    assert {(r.query_id, r["rank"], r.image_id, r.path) for r in got} == want and len(got) == len(want)


def test_search_of_nothing(spark, queries, vectors):
    manifest = spark.createDataFrame([(1, "/a/1.jpg")], "image_id long, path string")
    assert search(queries({1: [1, 0]}), vectors({1: [1, 0]}), manifest, "/b", pool="all").count() == 0
    assert search(queries({1: [1, 0]}).limit(0), vectors({1: [1, 0]}), manifest, "/a", pool="all").count() == 0
    assert search(queries({1: [1, 0]}), vectors({1: [1, 0]}).limit(0), manifest, "/a", pool="all").count() == 0
