"""Nearest neighbours, pools and whole searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumisift.catalog.tables import (
    DISK_SQL, IMAGES_SQL, disk, image_manifest, image_vectors, images, label_queries,
    label_scores, text_vectors, text_vectors_sql,
)
from lumisift.catalog.vectors import FLOOR_1, otsu_sql
from lumisift.functions.paths import prefix_filter
from lumisift.operators.ann import IvfIndex, ivf_build, knn_ivf, recall_at_k, search_ivf
from lumisift.operators.lsh import knn_lsh, lsh_build
from lumisift.operators.reduce import centroids
from lumisift.operators.search import (
    candidate_pool, decorate_results, order_and_limit, resolve_hits, search,
)
from lumisift.operators.topk import knn_exact
from lumisift.plans.scratch import materialize, scratch_path


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("score", 4).alias("score"))


def _text_queries(spark: SparkSession, folder: str) -> DataFrame:
    return text_vectors(spark, folder, "benchmark", "item_id").withColumnRenamed("item_id", "query_id")


def _knn(spark: SparkSession, folder: str) -> DataFrame:
    found = knn_exact(label_queries(spark, folder), image_vectors(spark, folder), 10)
    return _rounded(found, "query_id", "rank", "image_id")


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(candidate_pool(label_scores(spark, folder), "none", 10), "query_id", "rank", "image_id")


def _resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of which the manifest knows only the labels from 3 up."""
    hits = knn_exact(label_queries(spark, folder), image_vectors(spark, folder), 20)
    known = images(spark, folder).select(
        "image_id", F.when(F.col("label") >= 3, F.col("path")).otherwise("").alias("path"))
    return _rounded(resolve_hits(hits, known), "query_id", "rank", "path")


def _order(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(order_and_limit(label_scores(spark, folder), 7), "query_id", "rank", "image_id")


def _order_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every image ranked among those of its label."""
    return _rounded(order_and_limit(label_scores(spark, folder)), "query_id", "rank", "image_id")


def _prefix(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_filter(image_manifest(spark, folder), "/corpus/1").select("image_id", "path")


def run(spark: SparkSession, folder: str, directory: str = "/corpus", **options) -> DataFrame:
    return search(label_queries(spark, folder), image_vectors(spark, folder),
                  image_manifest(spark, folder), directory, **options)


def _search(**options):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _rounded(run(spark, folder, **options), "query_id", "rank", "path")

    return query


def _decorate(spark: SparkSession, folder: str) -> DataFrame:
    results = decorate_results(run(spark, folder, cutoff="none", limit=5))
    return results.select("query_id", "rank", "name", "score_label", "position")


def _search_text(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents that read most like each benchmark item."""
    corpus = text_vectors(spark, folder, "documents", "doc_id").withColumnRenamed("doc_id", "image_id")
    manifest = disk(spark, folder).select(F.col("doc_id").alias("image_id"), "path")
    found = search(_text_queries(spark, folder), corpus, manifest, "/corpus", limit=10)
    return _rounded(found, "query_id", "rank", "path")


def _label_cells(spark: SparkSession, folder: str) -> IvfIndex:
    """Cells around the label centres."""
    centres = centroids(images(spark, folder), "label").select(F.col("label").alias("cell"), "embedding")
    return ivf_build(image_vectors(spark, folder), scratch_path(spark, "ivf"), centres=centres)


def _ivf(nprobe: int):
    """Images near the benchmark texts."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = knn_ivf(_text_queries(spark, folder), _label_cells(spark, folder), 10, nprobe)
        return _rounded(found, "query_id", "rank", "image_id")

    return query


def _search_ivf(spark: SparkSession, folder: str) -> DataFrame:
    found = search_ivf(_text_queries(spark, folder), _label_cells(spark, folder),
                       image_manifest(spark, folder), "/corpus", nprobe=3, sigmas=1.0)
    return _rounded(found, "query_id", "rank", "path")


def _ivf_recall(spark: SparkSession, folder: str) -> DataFrame:
    vectors = image_vectors(spark, folder)
    queries = materialize(label_queries(spark, folder), "queries")
    index = ivf_build(vectors, scratch_path(spark, "ivf"), cells=16)
    return recall_at_k(knn_ivf(queries, index, 10, 11), knn_exact(queries, vectors, 10))


def _lsh(spark: SparkSession, folder: str) -> DataFrame:
    index = lsh_build(image_vectors(spark, folder), scratch_path(spark, "lsh"))
    return _rounded(knn_lsh(label_queries(spark, folder), index, 10), "query_id", "rank", "image_id")


def _lsh_recall(spark: SparkSession, folder: str) -> DataFrame:
    vectors = image_vectors(spark, folder)
    queries = materialize(label_queries(spark, folder), "queries")
    index = lsh_build(vectors, scratch_path(spark, "lsh"))
    return recall_at_k(knn_lsh(queries, index, 10), knn_exact(queries, vectors, 10))


def _lsh_all_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Directions of steps so wide that a query's neighbours are all buckets there are."""
    index = lsh_build(image_vectors(spark, folder), scratch_path(spark, "lsh"), tables=2, planes=3, width=16.0)
    found = knn_lsh(label_queries(spark, folder), index, 10, probes=27)
    return _rounded(found, "query_id", "rank", "image_id")


def _ivf_two_levels(spark: SparkSession, folder: str) -> DataFrame:
    """More cells than one level may have here, all of them looked at."""
    vectors = image_vectors(spark, folder)
    index = ivf_build(vectors, scratch_path(spark, "ivf"), cells=40, level=20)
    cells = index.centres().count()
    return _rounded(knn_ivf(label_queries(spark, folder), index, 10, cells), "query_id", "rank", "image_id")


def _reach(found: str):
    """Whether a recall is 0.9 or more."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return QUERIES[found](spark, folder).select("expected", (F.col("recall") >= 0.9).alias("enough"))

    return query


QUERIES = {
    "knn_exact": _knn,
    "candidate_pool": _pool,
    "resolve_hits": _resolve,
    "order_and_limit": _order,
    "order_all": _order_all,
    "prefix_filter": _prefix,
    "search_auto": _search(sigmas=1.0),
    "search_auto_floor": _search(sigmas=3.0),
    "search_none": _search(cutoff="none", limit=20),
    "search_none_open": _search(cutoff="none"),
    "search_fixed": _search(cutoff=0.2, limit=5),
    "search_directory": _search(directory="/corpus/3", cutoff="none", limit=4),
    "search_directory_pool": _search(directory="/corpus/3", cutoff="none", limit=4, pool_scope="prefix"),
    "search_auto_unpooled": _search(sigmas=1.0, pool="all"),
    "search_directory_unpooled": _search(directory="/corpus/3", cutoff="none", pool="all"),
    "search_limit_unpooled": _search(directory="/corpus/3", limit=6, sigmas=0.5, pool="all"),
    "search_text": _search_text,
    "decorate_results": _decorate,
    "knn_ivf": _ivf(3),
    "knn_ivf_all_cells": _ivf(10),
    "search_ivf": _search_ivf,
    "knn_ivf_recall": _ivf_recall,
    "knn_lsh": _lsh,
    "knn_lsh_recall": _lsh_recall,
    "knn_lsh_all_buckets": _lsh_all_buckets,
    "knn_ivf_two_levels": _ivf_two_levels,
    "knn_lsh_enough": _reach("knn_lsh_recall"),
    "knn_ivf_enough": _reach("knn_ivf_recall"),
}

# More candidates than any table has.
ALL = 2**62

_PLACE = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id)::INTEGER"


def _top_sql(scores: str, k: int) -> str:
    return f"SELECT *, {_PLACE} AS rank FROM {scores} QUALIFY rank <= {k}"


def search_sql(pool: int, keep: str, limit: int | None = None, directory: str = "/corpus/",
               scores: str = "scored") -> str:
    """CTEs ending in ``result(query_id, rank, score, path, image_id)``; ``keep`` is the cutoff."""
    cut = f"QUALIFY rank <= {limit}" if limit else ""
    return f"""
pool AS ({_top_sql(scores, pool)}),
found AS (SELECT query_id, image_id, score, path FROM pool WHERE starts_with(path, '{directory}')),
{otsu_sql("found", keep) + "," if keep.startswith("(") else ""}
result AS (
  SELECT query_id, {_PLACE} AS rank, score, path, image_id
  FROM found {"JOIN threshold USING (query_id) WHERE score >= threshold" if keep.startswith("(")
              else f"WHERE score >= {keep}"} {cut})"""


_RESULT = "SELECT query_id, rank, path, round(score, 4) + 0.0 AS score FROM result"
_NEAREST = "SELECT query_id, rank, image_id, round(score, 4) + 0.0 AS score"

_IVF_SQL = f"""
WITH {IMAGES_SQL}, {text_vectors_sql("benchmark", "item_id", "t")},
cell AS (
  SELECT image_id, query_id AS cell FROM scored
  QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, query_id) = 1),
probe AS (
  SELECT item_id, query_id AS cell FROM t, q
  QUALIFY row_number() OVER (
    PARTITION BY item_id ORDER BY round(list_dot_product(t.e, q.e), 10) DESC, query_id) <= {{probes}}),
near AS (
  SELECT item_id AS query_id, image_id, path, round(list_dot_product(t.e, v.e), 10) AS score
  FROM probe JOIN t USING (item_id) JOIN cell USING (cell) JOIN v USING (image_id))"""
_IVF_NEAREST_SQL = f"{_IVF_SQL} {_NEAREST} FROM ({_top_sql('near', 10)})"

SQL = {
    "knn_exact": f"WITH {IMAGES_SQL} {_NEAREST} FROM ({_top_sql('scored', 10)})",
    "knn_lsh_all_buckets": f"WITH {IMAGES_SQL} {_NEAREST} FROM ({_top_sql('scored', 10)})",
    "knn_ivf_two_levels": f"WITH {IMAGES_SQL} {_NEAREST} FROM ({_top_sql('scored', 10)})",
    "knn_lsh_enough": f"WITH {IMAGES_SQL} SELECT count(*) AS expected, true AS enough FROM ({_top_sql('scored', 10)})",
    "knn_ivf_enough": f"WITH {IMAGES_SQL} SELECT count(*) AS expected, true AS enough FROM ({_top_sql('scored', 10)})",
    "candidate_pool": f"WITH {IMAGES_SQL} {_NEAREST} FROM ({_top_sql('own_scores', 50)})",
    "resolve_hits": f"""
WITH {IMAGES_SQL} SELECT query_id, rank, path, round(score, 4) + 0.0 AS score
FROM ({_top_sql('scored', 20)}) WHERE label >= 3""",
    "order_and_limit": f"WITH {IMAGES_SQL} {_NEAREST} FROM ({_top_sql('own_scores', 7)})",
    "order_all": f"WITH {IMAGES_SQL} {_NEAREST} FROM (SELECT *, {_PLACE} AS rank FROM own_scores)",
    "prefix_filter": f"WITH {IMAGES_SQL} SELECT image_id, path FROM v WHERE label = 1",
    "search_auto": f"WITH {IMAGES_SQL}, {search_sql(500, FLOOR_1)} {_RESULT}",
    "search_auto_floor": f"WITH {IMAGES_SQL}, {search_sql(500, '(3 / sqrt(64))')} {_RESULT}",
    "search_none": f"WITH {IMAGES_SQL}, {search_sql(60, '0', 20)} {_RESULT}",
    "search_none_open": f"WITH {IMAGES_SQL}, {search_sql(200, '0')} {_RESULT}",
    "search_fixed": f"WITH {IMAGES_SQL}, {search_sql(50, '0.2', 5)} {_RESULT}",
    "search_directory": f"WITH {IMAGES_SQL}, {search_sql(50, '0', 4, '/corpus/3/')} {_RESULT}",
    "search_directory_pool": f"""
WITH {IMAGES_SQL}, inside AS (SELECT * FROM scored WHERE label = 3),
{search_sql(50, '0', 4, '/corpus/3/', 'inside')} {_RESULT}""",
    "search_auto_unpooled": f"WITH {IMAGES_SQL}, {search_sql(ALL, FLOOR_1)} {_RESULT}",
    "search_directory_unpooled": f"WITH {IMAGES_SQL}, {search_sql(ALL, '0', directory='/corpus/3/')} {_RESULT}",
    "search_limit_unpooled": f"WITH {IMAGES_SQL}, {search_sql(ALL, '(0.5 / sqrt(64))', 6, '/corpus/3/')} {_RESULT}",
    "search_text": f"""
WITH {DISK_SQL}, {text_vectors_sql("benchmark", "item_id", "t")}, {text_vectors_sql("documents", "doc_id", "d")},
scored AS (
  SELECT item_id AS query_id, doc_id AS image_id, path, round(list_dot_product(t.e, d.e), 10) AS score
  FROM t, d JOIN disk USING (doc_id)),
{search_sql(500, '(3 / sqrt(64))', 10)} {_RESULT}""",
    "decorate_results": f"""
WITH {IMAGES_SQL}, {search_sql(50, '0', 5)}
SELECT query_id, rank, parse_filename(path) AS name,
       CASE WHEN score > 0 THEN printf('%.2f', score) END AS score_label,
       rank || '/' || count(*) OVER (PARTITION BY query_id) AS position
FROM result""",
    "knn_ivf": _IVF_NEAREST_SQL.replace("{probes}", "3"),
    "knn_ivf_all_cells": _IVF_NEAREST_SQL.replace("{probes}", "10"),
    "search_ivf": f"{_IVF_SQL}, {search_sql(500, FLOOR_1, scores='near')} {_RESULT}".replace("{probes}", "3"),
}
