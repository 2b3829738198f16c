"""Grid surfaces from observations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from regionloom.operators.columns import attach
from regionloom.session import stage


def _on_grid(obs: DataFrame, value: str, resolution: int, lat: str, lon: str) -> DataFrame:
    """(row, col, grid_lat, grid_lon, lat, lon, v, n): every distinct place beside every grid node.

    Rows at one place are added up first. The nodes are generated beside each place and summed again per node inside
    the task, so only resolution squared sums per task are shuffled.
    """
    known = obs.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(value).isNotNull())
    box = known.agg(F.min(lat).alias("__s"), F.max(lat).alias("__n"), F.min(lon).alias("__w"), F.max(lon).alias("__e"))
    spots = known.groupBy(F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(
        F.sum(value).alias("v"), F.count(F.lit(1)).alias("n")
    )
    cells = F.explode(F.sequence(F.lit(0), F.lit(resolution * resolution - 1))).alias("node")
    wide = attach(spots, box).select("*", cells)
    row, col = F.floor(F.col("node") / resolution).cast("int"), (F.col("node") % resolution).cast("int")
    last = max(resolution - 1, 1)
    return wide.select(
        row.alias("row"),
        col.alias("col"),
        (F.col("__s") + (F.col("__n") - F.col("__s")) * row / last).alias("grid_lat"),
        (F.col("__w") + (F.col("__e") - F.col("__w")) * col / last).alias("grid_lon"),
        "lat", "lon", "v", "n",
    )


def cut_off(bandwidth: float, tolerance: float) -> float:
    """Distance beyond which the kernel is below ``tolerance``."""
    return bandwidth * math.sqrt(2 * math.log(1 / tolerance))


def risk_surface(
    obs: DataFrame, bandwidth: float, resolution: int = 24, value: str = "metric_value", lat="latitude", lon="longitude", tolerance: float = 1e-13
) -> DataFrame:
    """Sum of metric x exp(-d^2 / 2h^2) at the nodes of a grid over the bounding box, d and h in degrees (choice ours).

    A place meets the nodes within the cut-off only, so the rows fall with the bandwidth and the resolution; what is left
    out at a node is at most ``tolerance`` times the sum of the sizes of all metrics. Places that share a place are added
    up first. A node out of reach of all places has risk 0.
    """
    known = obs.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(value).isNotNull())
    box = stage(known.agg(F.min(lat).alias("__s"), F.max(lat).alias("__n"), F.min(lon).alias("__w"), F.max(lon).alias("__e")))
    spots = known.groupBy(F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(F.sum(value).alias("v"))
    last = max(resolution - 1, 1)
    reach = cut_off(bandwidth, tolerance)
    wide = attach(spots, box)

    def steps(at: str, low: str, high: str) -> Column:
        """Numbers of the grid lines of one axis within reach; with no extent all lines coincide."""
        size = (F.col(high) - F.col(low)) / last
        first = F.when(size > 0, F.ceil((F.col(at) - reach - F.col(low)) / size - 1e-9)).otherwise(0)
        end = F.when(size > 0, F.floor((F.col(at) + reach - F.col(low)) / size + 1e-9)).otherwise(resolution - 1)
        first, end = F.greatest(first, F.lit(0)).cast("int"), F.least(end, F.lit(resolution - 1)).cast("int")
        return F.when(first <= end, F.sequence(first, end))

    met = wide.withColumn("row", F.explode(steps("lat", "__s", "__n"))).withColumn("col", F.explode(steps("lon", "__w", "__e")))
    grid_lat = F.col("__s") + (F.col("__n") - F.col("__s")) * F.col("row") / last
    grid_lon = F.col("__w") + (F.col("__e") - F.col("__w")) * F.col("col") / last
    dy, dx = grid_lat - F.col("lat"), grid_lon - F.col("lon")
    square = dy * dy + dx * dx
    kernel = F.exp(-square / (2 * bandwidth * bandwidth))
    sums = met.where(square <= reach * reach * (1 + 1e-9)).groupBy("row", "col").agg(F.sum(F.col("v") * kernel).alias("risk"))
    nodes = box.where("__s IS NOT NULL").select("*", F.explode(F.sequence(F.lit(0), F.lit(resolution * resolution - 1))).alias("node"))
    nodes = nodes.withColumns({"row": F.floor(F.col("node") / resolution).cast("int"), "col": (F.col("node") % resolution).cast("int")})
    nodes = nodes.select("row", "col", grid_lat.alias("grid_lat"), grid_lon.alias("grid_lon"))
    return nodes.join(sums, ["row", "col"], "left").withColumn("risk", F.coalesce("risk", F.lit(0.0)))


def spatial_interpolation(
    obs: DataFrame, resolution: int = 24, value: str = "metric_value", power: float = 2.0, lat="latitude", lon="longitude"
) -> DataFrame:
    """Inverse distance weighting (Shepard 1968) on the grid; a node that hits places takes their mean (choice ours)."""
    at = _on_grid(obs, value, resolution, lat, lon)
    dy, dx = F.col("grid_lat") - F.col("lat"), F.col("grid_lon") - F.col("lon")
    square = F.col("sq")
    weight = F.when(square > 0, F.lit(1.0) / (square if power == 2.0 else F.pow(square, power / 2)))
    sums = at.withColumn("sq", dy * dy + dx * dx).groupBy("row", "col").agg(
        F.min("grid_lat").alias("grid_lat"),
        F.min("grid_lon").alias("grid_lon"),
        F.sum(weight * F.col("v")).alias("wv"),
        F.sum(weight * F.col("n")).alias("w"),
        F.sum(F.when(square == 0, F.col("v"))).alias("hit"),
        F.sum(F.when(square == 0, F.col("n"))).alias("hits"),
    )
    estimate = F.coalesce(F.try_divide("hit", "hits"), F.try_divide("wv", "w"))
    return sums.select("row", "col", "grid_lat", "grid_lon", estimate.alias("estimate"))
