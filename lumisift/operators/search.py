"""Search: pool, path, cutoff, order and limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lumisift.functions.paths import base_name, prefix_filter
from lumisift.functions.vectors import noise_floor
from lumisift.operators.cutoff import Cutoff, apply_cutoff, parse_cutoff
from lumisift.operators.topk import as_blocks, knn_exact, merge_top
from lumisift.operators.unpooled import search_all
from lumisift.plans.blocks import Blocks
from lumisift.plans.running import in_ranges, running_totals

# How many candidates are looked at before paths and cutoff apply.
AUTO_POOL = 500
OPEN_POOL = 200
POOL_FACTOR = 3
POOL_MIN = 50
POOL_MAX = 500

# A table of this many hits (three numbers each) is at most about 25 MB.
BROADCAST_HITS = 1_000_000


def pool_size(cutoff: Cutoff, limit: int) -> int:
    """Candidates per query: 500 for the adaptive cutoff, else three times the limit in bounds."""
    if parse_cutoff(cutoff) == "auto":
        return AUTO_POOL
    if limit == 0:
        return OPEN_POOL
    return min(max(limit * POOL_FACTOR, POOL_MIN), POOL_MAX)


def searched(cutoff: Cutoff, limit: int, pool: int | None) -> int:
    """Candidates per query of a search: ``pool`` or the fixed rule, and never fewer than the limit asks for."""
    return max(pool_size(cutoff, limit) if pool is None else pool, limit)


def candidate_pool(
    scored: DataFrame, cutoff: Cutoff = "auto", limit: int = 0, query_id: str = "query_id"
) -> DataFrame:
    """The best scored rows of each query that the cutoff gets to see."""
    return merge_top(scored, pool_size(cutoff, limit), query_id)


def resolve_hits(scored: DataFrame, manifest: DataFrame, most: int | None = None) -> DataFrame:
    """Add ``path`` by ``image_id``; hits without a live row drop out.

    ``most`` is an upper bound of the number of hits, when the caller knows one:
    if it is small the hits are broadcast and the manifest is not shuffled.
    """
    live = manifest.where(F.col("path") != "").select("image_id", "path")
    if most is not None and most <= BROADCAST_HITS:
        scored = F.broadcast(scored)
    return scored.join(live, "image_id")


def order_and_limit(
    df: DataFrame, limit: int = 0, query_id: str = "query_id", pooled: bool = False
) -> DataFrame:
    """``rank`` rows of each query by score descending, then image_id; 0 keeps all.

    Without a limit, queries of any size are ranked over ranges of the order, unless
    ``pooled=True`` says that they are candidate pools, which fit one task.
    """
    df = df.drop("rank")
    if limit > 0:
        return merge_top(df, limit, query_id)
    if pooled:
        order = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc("image_id"))
        return df.withColumn("rank", F.row_number().over(order))
    ordered = in_ranges(df.withColumn("_order", F.struct(-F.col("score"), "image_id")), [query_id], "_order")
    ranked = running_totals(ordered, [query_id], "_order", {"rank": F.lit(1).cast("long")})
    return ranked.drop("_order").withColumn("rank", F.col("rank").cast("int"))


def search(
    queries: DataFrame | Blocks,
    vectors: DataFrame,
    manifest: DataFrame,
    directory: str,
    limit: int = 0,
    cutoff: Cutoff = "auto",
    pool_scope: str = "corpus",
    sigmas: float = 3.0,
    query_id: str = "query_id",
    pool: int | str | None = None,
) -> DataFrame:
    """Images under ``directory`` that match each query: ``(query_id, rank, score, path, image_id)``.

    The cutoff sees the best ``pool`` images of a query; without it the rule of :func:`pool_size`
    holds, except that a larger ``limit`` is always met. With neither, no more come back than that rule says.
    ``pool_scope="corpus"`` fills the pool from the whole index, so that other
    directories can crowd it; ``"prefix"`` fills it from ``directory`` alone. With ``pool="all"``
    there is none: the cutoff sees every image under ``directory``, and all that pass come back.
    """
    if pool_scope not in ("corpus", "prefix"):
        raise ValueError(f"invalid pool_scope: {pool_scope} (use corpus or prefix)")
    cutoff = parse_cutoff(cutoff)
    blocks = as_blocks(queries, query_id)
    if pool == "all":
        return search_all(blocks, vectors, manifest, directory, limit, cutoff, sigmas, query_id)
    pool = searched(cutoff, limit, pool)
    if pool_scope == "prefix":
        inside = prefix_filter(manifest, directory).select("image_id")
        vectors = vectors.join(inside, "image_id", "left_semi")
    hits = knn_exact(blocks, vectors, pool, query_id)
    floor = noise_floor(max(blocks.dim, 1), sigmas)
    return finish_search(
        hits, manifest, directory, limit, cutoff, floor, query_id, most=blocks.rows * pool
    )


def finish_search(
    hits: DataFrame,
    manifest: DataFrame,
    directory: str,
    limit: int,
    cutoff: Cutoff,
    floor: float,
    query_id: str = "query_id",
    most: int | None = None,
) -> DataFrame:
    """From candidate pools, however found, to ranked paths."""
    found = prefix_filter(resolve_hits(hits, manifest, most), directory)
    passed = apply_cutoff(found, cutoff, floor, query_id, pooled=True)
    ranked = order_and_limit(passed, limit, query_id, pooled=True)
    return ranked.select(query_id, "rank", "score", "path", "image_id")


def decorate_results(results: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Base name, two-digit score (none unless positive) and ``i/n`` position of ranked rows."""
    sizes = results.groupBy(query_id).agg(F.count("*").alias("n"))
    label = F.when(F.col("score") > 0, F.format_string("%.2f", F.col("score")))
    return (
        results.join(sizes, query_id)
        .withColumn("name", F.when(base_name("path") == "", F.col("path")).otherwise(base_name("path")))
        .withColumn("score_label", label)
        .withColumn("position", F.format_string("%d/%d", F.col("rank"), F.col("n")))
        .drop("n")
    )


def result_lines(results: DataFrame, scores: bool = True) -> DataFrame:
    """One text ``line`` per result row: the path, with the four-digit score before it."""
    line = F.format_string("%.4f\t%s", F.col("score"), F.col("path")) if scores else F.col("path")
    return results.withColumn("line", line)
