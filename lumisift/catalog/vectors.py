"""Vector functions, reductions and score statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumisift.catalog.tables import (
    IMAGES_SQL, image_vectors, images, label_scores, table,
)
from lumisift.functions.vectors import dot, l2_normalize, noise_floor, rejected_vectors, valid_vectors
from lumisift.operators.cutoff import apply_cutoff, otsu_threshold
from lumisift.operators.reduce import (
    embedding_lookup, linear_project, mean_pool, softmax_scores, summarize_runs,
)
from lumisift.operators.topk import score_pairs


def _entries(df: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    """One row per entry of a vector, at four digits."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).select(
        *keys, "pos", F.round(F.col("x").cast("double"), 4).alias("x"))


def _normalize(spark: SparkSession, folder: str) -> DataFrame:
    scaled = images(spark, folder).withColumn(
        "embedding", F.transform("embedding", lambda x: x * F.col("label").cast("float")))
    return _entries(scaled.withColumn("embedding", l2_normalize("embedding")), "image_id")


def _dot(spark: SparkSession, folder: str) -> DataFrame:
    return images(spark, folder).select(
        "image_id", F.round(dot("embedding", F.reverse("embedding")), 4).alias("score"))


def _damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of label 0 are one number short, those of label 1 have a NaN."""
    broken = (
        F.when(F.col("label") == 0, F.slice("embedding", 1, F.size("embedding") - 1))
        .when(F.col("label") == 1, F.concat(F.slice("embedding", 1, F.size("embedding") - 1),
                                            F.array(F.lit(float("nan")).cast("float"))))
        .otherwise(F.col("embedding"))
    )
    return images(spark, folder).withColumn("embedding", broken)


def _valid(spark: SparkSession, folder: str) -> DataFrame:
    kept = valid_vectors(_damaged(spark, folder), 64).select("image_id", F.lit("kept").alias("status"))
    left = rejected_vectors(_damaged(spark, folder), 64)
    return kept.unionByName(left.select("image_id", F.lit("rejected").alias("status")))


def _mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(mean_pool(images(spark, folder), ["label"]), "label")


def _softmax(spark: SparkSession, folder: str) -> DataFrame:
    weights = softmax_scores(label_scores(spark, folder), "query_id")
    return weights.select("query_id", "image_id", F.round("weight", 6).alias("weight"))


def _project(spark: SparkSession, folder: str) -> DataFrame:
    """Distance to each label's mean as a linear score: v.m - |m|^2 / 2."""
    means = mean_pool(images(spark, folder), ["label"])
    weights = means.select(F.col("label").alias("col"), F.col("embedding").alias("w"),
                           dot("embedding", "embedding").alias("b"))
    projected = linear_project(image_vectors(spark, folder), weights, 1.0, -0.5)
    return _entries(projected, "image_id", vector="projected")


def _lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector's own row, the row as far from the end, and row 0, which all lists share."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("idx"), "embedding")
    lists = rows.select(F.col("idx").alias("key"),
                        F.array(F.col("idx"), -F.col("idx") - 1, F.lit(0).cast("long")).alias("ids"))
    found = embedding_lookup(lists, rows)
    return found.select("key", F.posexplode("rows").alias("pos", "e")).select(
        "key", "pos", F.round(F.col("e")[0].cast("double"), 4).alias("first"),
        F.round(F.element_at("e", -1).cast("double"), 4).alias("last"))


def _noise_floor(spark: SparkSession, folder: str) -> DataFrame:
    dims = images(spark, folder).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    return dims.select("dim", "n", F.round(noise_floor(F.col("dim"), 3.0), 6).alias("floor"))


def _otsu(spark: SparkSession, folder: str) -> DataFrame:
    found = otsu_threshold(label_scores(spark, folder), ["query_id"], noise_floor(64, 1.0))
    return found.select("query_id", F.round("threshold", 4).alias("threshold"))


def _cutoff(mode):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        passed = apply_cutoff(label_scores(spark, folder), mode, noise_floor(64, 1.0))
        return passed.select("query_id", "image_id", F.round("score", 4).alias("score"))

    return query


def _score_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return label_scores(spark, folder).select("query_id", "image_id", F.round("score", 4).alias("score"))


def _summarize(spark: SparkSession, folder: str) -> DataFrame:
    runs = summarize_runs(table(spark, folder, "events"), "value", ["event_type"])
    return runs.select("event_type", F.round("min", 4).alias("min"), F.round("mean", 4).alias("mean"),
                       F.round("max", 4).alias("max"))


QUERIES = {
    "l2_normalize": _normalize,
    "dot": _dot,
    "valid_vectors": _valid,
    "mean_pool": _mean_pool,
    "softmax_scores": _softmax,
    "linear_project": _project,
    "embedding_lookup": _lookup,
    "noise_floor": _noise_floor,
    "otsu_threshold": _otsu,
    "apply_cutoff_auto": _cutoff("auto"),
    "apply_cutoff_none": _cutoff("none"),
    "apply_cutoff_fixed": _cutoff(0.25),
    "score_pairs": _score_pairs,
    "summarize_runs": _summarize,
}


def otsu_sql(scores: str, floor: str) -> str:
    """CTEs ending in ``threshold(query_id, threshold)`` for the rows of ``scores``."""
    return f"""
counted AS (
  SELECT query_id, score AS s, image_id FROM {scores} WHERE score >= {floor} AND NOT isnan(score)),
stepped AS (
  SELECT query_id, s, row_number() OVER w AS w0, sum(s) OVER w AS sum0, lead(s) OVER w AS s1,
         count(*) OVER g AS n, sum(s) OVER g AS total, min(s) OVER g AS lowest
  FROM counted
  WINDOW w AS (PARTITION BY query_id ORDER BY s, image_id), g AS (PARTITION BY query_id)),
spread AS (
  SELECT *, w0 * (n - w0) * pow(sum0 / w0 - (total - sum0) / (n - w0), 2) AS between_classes
  FROM stepped WHERE s1 IS NOT NULL),
best AS (
  SELECT query_id, (s + s1) / 2 AS split,
         row_number() OVER (PARTITION BY query_id ORDER BY between_classes DESC, w0) AS place
  FROM spread WHERE between_classes > 0),
sizes AS (SELECT query_id, count(*) AS n, min(s) AS lowest FROM counted GROUP BY query_id),
threshold AS (
  SELECT query_id, CASE WHEN n >= 3 THEN greatest(coalesce(split, lowest), {floor})
                        ELSE {floor} END AS threshold
  FROM (SELECT DISTINCT query_id FROM {scores})
  LEFT JOIN sizes USING (query_id)
  LEFT JOIN (SELECT query_id, split FROM best WHERE place = 1) USING (query_id))"""


FLOOR_1 = "(1 / sqrt(64))"
_ROUNDED = "SELECT query_id, image_id, round(score, 4) + 0.0 AS score"

SQL = {
    "l2_normalize": """
WITH v AS (SELECT vec_id + 1 AS image_id, list_transform(embedding, lambda x: (x * label)::FLOAT::DOUBLE) AS e
           FROM embeddings),
n AS (SELECT image_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v)
SELECT image_id, (i - 1)::INTEGER AS pos,
       round((CASE WHEN norm > 1e-6 THEN e[i] / norm ELSE e[i] END)::FLOAT::DOUBLE, 4) + 0.0 AS x
FROM n, unnest(range(1, len(e) + 1)) AS t(i)""",
    "dot": f"WITH {IMAGES_SQL} SELECT image_id, round(list_dot_product(e, list_reverse(e)), 4) + 0.0 AS score FROM v",
    "valid_vectors": """
SELECT vec_id + 1 AS image_id, CASE WHEN label IN (0, 1) THEN 'rejected' ELSE 'kept' END AS status
FROM embeddings""",
    "mean_pool": f"""
WITH {IMAGES_SQL} SELECT label, (i - 1)::INTEGER AS pos, round(x, 4) + 0.0 AS x FROM label_mean""",
    "softmax_scores": f"""
WITH {IMAGES_SQL},
p AS (SELECT query_id, image_id, exp(score - max(score) OVER (PARTITION BY query_id)) AS x FROM own_scores)
SELECT query_id, image_id, round(x / sum(x) OVER (PARTITION BY query_id), 6) AS weight FROM p""",
    "linear_project": f"""
WITH {IMAGES_SQL},
means AS (SELECT label, list(x ORDER BY i) AS m, sum(x * x) AS b FROM label_mean GROUP BY label)
SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY means.label) - 1)::INTEGER AS pos,
       round(list_dot_product(e, m) - 0.5 * b, 4) + 0.0 AS x
FROM v, means""",
    "embedding_lookup": """
WITH lists AS (
  SELECT vec_id AS key, unnest([vec_id, (SELECT count(*) FROM embeddings) - vec_id - 1, 0]) AS idx,
         unnest([0, 1, 2]) AS pos FROM embeddings)
SELECT key, pos::INTEGER AS pos, round(e.embedding[1]::DOUBLE, 4) + 0.0 AS first,
       round(e.embedding[-1]::DOUBLE, 4) + 0.0 AS last
FROM lists JOIN embeddings e ON e.vec_id = lists.idx""",
    "noise_floor": """
SELECT len(embedding)::INTEGER AS dim, count(*) AS n, round(3 / sqrt(len(embedding)), 6) AS floor
FROM embeddings GROUP BY len(embedding)""",
    "otsu_threshold": f"""
WITH {IMAGES_SQL}, {otsu_sql("own_scores", FLOOR_1)}
SELECT query_id, round(threshold, 4) + 0.0 AS threshold FROM threshold""",
    "apply_cutoff_auto": f"""
WITH {IMAGES_SQL}, {otsu_sql("own_scores", FLOOR_1)}
{_ROUNDED} FROM own_scores JOIN threshold USING (query_id) WHERE score >= threshold""",
    "apply_cutoff_none": f"WITH {IMAGES_SQL} {_ROUNDED} FROM own_scores WHERE score >= 0",
    "apply_cutoff_fixed": f"WITH {IMAGES_SQL} {_ROUNDED} FROM own_scores WHERE score >= 0.25",
    "score_pairs": f"WITH {IMAGES_SQL} {_ROUNDED} FROM own_scores",
    "summarize_runs": """
SELECT event_type, round(min(value), 4) + 0.0 AS min, round(avg(value), 4) + 0.0 AS mean, round(max(value), 4) + 0.0 AS max
FROM events GROUP BY event_type""",
}
