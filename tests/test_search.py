import pytest

from lumisift.operators.search import (
    candidate_pool, decorate_results, order_and_limit, pool_size, resolve_hits, result_lines, search,
)


@pytest.mark.parametrize("cutoff, limit, size", [
    ("auto", 0, 500), ("auto", 3, 500), ("none", 0, 200), (0.2, 0, 200),
    ("none", 5, 50), ("none", 17, 51), (0.2, 100, 300), ("none", 1000, 500),
])
def test_pool_size(cutoff, limit, size):
    assert pool_size(cutoff, limit) == size


@pytest.fixture
def corpus(spark, vectors):
    """60 near images in /a, 5 less near ones in /ab and /b, and a removed row."""
    points = {i: [1.0, 0.001 * i] for i in range(1, 61)}
    points.update({100 + i: [0.5, 0.01 * i] for i in range(5)})
    points[200] = [1.0, 0.0]
    paths = [(i, f"/a/{i}.jpg") for i in range(1, 61)]
    paths += [(100 + i, f"/{'ab' if i % 2 else 'b'}/{i}.jpg") for i in range(5)] + [(200, "")]
    return vectors(points), spark.createDataFrame(paths, "image_id long, path string")


def found(df):
    return [(r["rank"], r.path) for r in df.orderBy("rank").collect()]


def test_other_directories_crowd_the_pool(queries, corpus):
    asked = queries({1: [1, 0]})
    assert found(search(asked, *corpus, "/b", limit=2, cutoff="none")) == []
    got = found(search(asked, *corpus, "/b", limit=2, cutoff="none", pool_scope="prefix"))
    assert got == [(1, "/b/0.jpg"), (2, "/b/2.jpg")]


def test_prefix_is_a_directory(queries, corpus):
    got = found(search(queries({1: [1, 0]}), *corpus, "/a/", cutoff="none"))
    assert len(got) == 60 and all(p.startswith("/a/") for _, p in got)


def test_removed_rows_never_appear_but_fill_the_pool(queries, corpus):
    got = found(search(queries({1: [1, 0]}), *corpus, "/", limit=16, cutoff="none"))
    assert len(got) == 16 and "" not in [p for _, p in got]


def test_cutoff_comes_before_limit(queries, corpus):
    got = search(queries({1: [1, 0]}), *corpus, "/", limit=3, cutoff=1.5)
    assert got.count() == 0
    assert search(queries({1: [0, -1]}), *corpus, "/", cutoff="none").count() == 1  # 0 passes, negative not


def test_equal_scores_go_by_id(queries, vectors, spark):
    points = vectors({i: [1, 0] for i in (9, 4, 7)})
    manifest = spark.createDataFrame([(i, f"/x/{i}") for i in (9, 4, 7)], "image_id long, path string")
    got = search(queries({1: [1, 0], 2: [1, 0]}), points, manifest, "/x", limit=2, cutoff=0.5)
    assert sorted((r.query_id, r["rank"], r.image_id) for r in got.collect()) == [
        (1, 1, 4), (1, 2, 7), (2, 1, 4), (2, 2, 7)]


def test_auto_with_few_scores_falls_back_to_the_floor(queries, vectors, spark):
    points = vectors({1: [1, 0, 0, 0], 2: [0.9, 0, 0, 0], 3: [0.1, 0, 0, 0]})
    manifest = spark.createDataFrame([(i, f"/x/{i}") for i in (1, 2, 3)], "image_id long, path string")
    got = search(queries({1: [1, 0, 0, 0]}), points, manifest, "/x", sigmas=1.0)
    assert sorted(r.image_id for r in got.collect()) == [1, 2]


def test_bad_options(queries, corpus):
    with pytest.raises(ValueError):
        search(queries({1: [1, 0]}), *corpus, "/", pool_scope="all")
    with pytest.raises(ValueError):
        search(queries({1: [1, 0]}), *corpus, "/", cutoff="some")


def test_pool_limit_and_lines(spark):
    rows = [(q, i, 1.0 / (i + q)) for q in (1, 2) for i in range(1, 71)]
    scored = spark.createDataFrame(rows, "query_id long, image_id long, score double")
    assert candidate_pool(scored, "none", 10).groupBy("query_id").count().collect()[0]["count"] == 50
    for pooled in (True, False):
        ranked = order_and_limit(scored, 0, pooled=pooled).collect()
        assert len(ranked) == 140 and all(r["rank"] == r.image_id for r in ranked)
    manifest = spark.createDataFrame([(1, "/a/b/c.jpg"), (2, "/d")], "image_id long, path string")
    kept = order_and_limit(resolve_hits(scored, manifest), 5)
    assert kept.count() == 4
    lines = {r.line for r in result_lines(kept.where("query_id = 2")).collect()}
    assert lines == {"0.3333\t/a/b/c.jpg", "0.2500\t/d"}
    assert {r.line for r in result_lines(kept, scores=False).collect()} == {"/a/b/c.jpg", "/d"}


def test_decorate(spark):
    rows = [(1, 1, 0.456, "/a/b.jpg"), (1, 2, 0.0, "/"), (2, 1, -0.2, "c.jpg")]
    df = spark.createDataFrame(rows, "query_id long, rank int, score double, path string")
    got = {(r.query_id, r["rank"]): (r.name, r.score_label, r.position) for r in decorate_results(df).collect()}
    assert got == {(1, 1): ("b.jpg", "0.46", "1/2"), (1, 2): ("/", None, "2/2"), (2, 1): ("c.jpg", None, "1/1")}


def test_limit_is_met_beyond_the_pool(spark, queries, vectors):
    points = vectors({i: [1.0, 0.0001 * i] for i in range(1, 801)})
    manifest = spark.createDataFrame([(i, f"/a/{i}.jpg") for i in range(1, 801)], "image_id long, path string")
    got = search(queries({1: [1, 0]}), points, manifest, "/a", limit=700, cutoff=0.2)
    assert got.count() == 700
    assert search(queries({1: [1, 0]}), points, manifest, "/a", limit=2, cutoff=0.2, pool=1).count() == 2


def test_queries_of_another_length_cost_no_others(spark, vectors):
    rows = [(0, None), (1, [1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    asked = spark.createDataFrame(rows, "query_id short, embedding array<float>")
    manifest = spark.createDataFrame([(7, "/a/7.jpg")], "image_id long, path string")
    got = search(asked, vectors({7: [1, 1]}), manifest, "/a", cutoff="none")
    assert [(r.query_id, r.path) for r in got.orderBy("query_id").collect()] == [(2, "/a/7.jpg"), (3, "/a/7.jpg")]
