"""Connected components of a graph in a table, by alternating large and small stars.

A large star ties all larger neighbours of a node to the smallest node around it, a small
star the smaller ones; the edges of a component turn into one star around its smallest
node after a number of rounds that grows with the logarithm of its size. Smallest
neighbours are summed up before they are joined, so a node with very many neighbours is
no task's own: the join that follows has plain tables on both sides and can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumisift.plans.scratch import materialize


def _star(edges: DataFrame, smaller: bool) -> DataFrame:
    """``edges`` ``(u, v)`` with ``u > v``: one star step."""
    there = edges if smaller else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(there.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "star")
    if smaller:
        # The smaller neighbours of u, and u itself, go to the smallest of them.
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = there.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, which has none itself."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    centres = edges.select(F.col("v").alias("u")).distinct()
    return twice.unionByName(edges.join(centres, "u", "left_semi").select("u")).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of every node that an edge ``(u, v)`` names; the label is the smallest node reached.

    Edges may repeat, point either way or to their own node; nulls are left out. Without edges the result is empty.
    """
    clean = edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(clean, "edges")
    while not _only_stars(now):
        now = materialize(_star(materialize(_star(now, smaller=False), "edges"), smaller=True), "edges")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def in_blocks(lists: DataFrame, block: int) -> DataFrame:
    """``(rep, cluster, block, low, high)``: members of overlapping lists ``(pair, rep)``, once per pair of blocks.

    Lists that share a member make a cluster, which a hash cuts into blocks of about ``block`` members. Grouped by
    ``cluster, low, high``, any two members of a list meet in a group of at most twice that many or so.
    """
    hubs = materialize(lists.groupBy("pair").agg(F.min("rep").alias("hub")), "list-hubs")
    tied = lists.join(hubs, "pair").select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct()
    cluster = materialize(components(tied).toDF("rep", "cluster"), "clusters")
    sizes = materialize(cluster.groupBy("cluster").agg(
        F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("blocks")), "cluster-sizes")
    placed = cluster.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return met.select("rep", "cluster", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
