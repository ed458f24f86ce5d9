"""Connected components of large graphs by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _lowest(edges: DataFrame) -> DataFrame:
    """For each u the smallest of itself and its neighbours; partial minima come before the shuffle."""
    return stored(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "lowest")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    linked = both.join(_lowest(both).hint("merge"), "u").where(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = _lowest(down)
    to_low = down.join(lowest.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_low.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (longs). Rows node, root for every node with an edge to another; root is the smallest node reachable.

    A node's neighbours are never gathered: each round takes minima with
    partial sums and joins them back, so that a hub is split among tasks.
    """
    edges = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = stored(_small_star(stored(_large_star(edges), "large-star")), "small-star")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
