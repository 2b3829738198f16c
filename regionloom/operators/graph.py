"""Neighbour graphs as vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from regionloom.operators.neighbours import adjacency_edges, k_nearest, places
from regionloom.session import stage


def adjacency_graph(df: DataFrame, radius_km: float, lat="latitude", lon="longitude") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): distinct places with their row counts, and place pairs within a radius."""
    nodes = places(df, lat, lon).select("lat", "lon", F.col("w").alias("row_count"))
    return nodes, adjacency_edges(df, radius_km, lat, lon)


def spatial_network(df: DataFrame, features: list[str], k: int, row_id: str) -> DataFrame:
    """Undirected edges (a, b) of the k-nearest graph, each once."""
    found = k_nearest(df, df, features, k, row_id, exclude_same_id=True)
    return found.select(
        F.least("id", "neighbour_id").alias("a"), F.greatest("id", "neighbour_id").alias("b")
    ).distinct()


def degrees(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    ends = edges.select(F.explode(F.array(a, b)).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every vertex to the smallest one around it: those above the vertex (large) or the
    vertex and those below it (small)."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
        linked = around.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = around.groupBy("u").agg(F.min("v").alias("low"))
        below = around.join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        linked = below.union(low.select("u", "low"))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id of every connected component of the vertices that have an edge.

    Alternating stars (Kiveris et al. 2014) on staged edge tables: the rounds grow with the logarithm of the graph,
    and a hub is one key of a grouped minimum, reduced in each task before the shuffle.
    """
    current = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        current = stage(_star(stage(_star(current, large=True)), large=False))
        # the same number and the same sum of hashes: nothing moved
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            leaves = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
            return leaves.union(current.select("b", F.col("b").alias("component")).distinct())
        mark = now


def network_summary(edges: DataFrame) -> DataFrame:
    """Per component: vertices, mean and largest degree."""
    parts = components(edges)
    return parts.join(degrees(edges), "id").groupBy("component").agg(
        F.count(F.lit(1)).alias("vertices"), F.avg("degree").alias("degree_mean"), F.max("degree").alias("degree_max")
    )
