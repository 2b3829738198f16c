"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from regionloom.session import stage


def components(links: DataFrame) -> DataFrame:
    """``v`` and ``root`` for every vertex of the links (``a``, ``b``); equal roots for the vertices of a component.

    Every vertex hooks onto the one with the smallest random rank among itself and its neighbours; the links are then
    drawn between the hooks, and those that became loops or repeat go. Each round leaves a fraction of the vertices, so
    the rounds grow with the logarithm of their number whatever the shape. Every round is written down.
    """
    links = stage(links.select("a", "b").where("a <> b").distinct())
    ends = links.select(F.col("a").alias("v")).union(links.select(F.col("b").alias("v"))).distinct()
    roots = stage(ends.select("v", F.col("v").alias("root")))
    turn = 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own = links.select("a", F.col("a").alias("b")).union(links.select(F.col("b"), F.col("b")))
        ranked = both.unionByName(own)
        hooks = stage(ranked.groupBy("a").agg(F.min_by("b", F.struct(F.xxhash64(F.lit(turn), "b"), "b")).alias("hook")))
        near, far = hooks.toDF("a", "x"), hooks.toDF("b", "y")
        links = stage(
            links.join(near, "a").join(far, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
        )
        moved = roots.join(hooks.toDF("root", "hook"), "root", "left")
        roots = stage(moved.select("v", F.coalesce("hook", "root").alias("root")))
        turn += 1
    return roots
