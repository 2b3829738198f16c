"""Footprints of sources: hulls, overlaps in space and time, polygon joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from regionloom.functions import geo
from regionloom.functions.scalars import iso_date, to_numeric
from regionloom.operators.overlaps import later_totals, meeting_pairs
from regionloom.session import stage
from regionloom.operators.joins import centroid_fallback
from regionloom.schema import RING, RING_TYPE


def point_cloud(df: DataFrame, lat: str, lon: str, centre, radius: float, earth: float = geo.EARTH_MILES) -> DataFrame:
    """Numeric (lat, lon) of the rows within a radius."""
    points = df.select(to_numeric(lat).alias("lat"), to_numeric(lon).alias("lon"))
    return points.where(geo.in_radius("lat", "lon", centre, radius, earth))


def point_cloud_or_centroids(df: DataFrame, lat_names, lon_names, county: str, centroids: DataFrame, centre, radius) -> DataFrame:
    """The point cloud of the first known place columns; without any, the centroids of the counties."""
    lat = next((c for c in lat_names if c in df.columns), None)
    lon = next((c for c in lon_names if c in df.columns), None)
    if lat and lon:
        return point_cloud(df, lat, lon, centre, radius)
    return centroid_fallback(df, county, centroids).select("lat", "lon")


def hull_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corner numbers of the convex hull, counter-clockwise (monotone chain); small helper inside tasks."""
    keep = np.arange(len(x))
    if len(x) > 64:
        # points strictly inside the polygon of the extremes in 16 directions cannot be corners
        angles = np.arange(16) * (np.pi / 8)
        far = np.unique(np.argmax(np.outer(np.cos(angles), x) + np.outer(np.sin(angles), y), axis=1))
        core = far[hull_of(x[far], y[far])]
        if len(core) > 2:
            ax, ay = x[core], y[core]
            bx, by = np.roll(ax, -1), np.roll(ay, -1)
            side = (bx - ax)[:, None] * (y - ay[:, None]) - (by - ay)[:, None] * (x - ax[:, None])
            keep = np.flatnonzero(~(side > 1e-12).all(axis=0))
    order = keep[np.lexsort((y[keep], x[keep]))]
    points = [(x[i], y[i], i) for i in order]

    def chain(sequence):
        out = []
        for p in sequence:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    corners = chain(points) + chain(points[::-1])
    return np.array([c[2] for c in (corners or points[:1])], dtype=int)


def _reduce_hulls(batches):
    kept: dict = {}
    for batch in batches:
        for key, part in batch.groupby("key", dropna=False, sort=False):
            both = pd.concat([kept[key], part]) if key in kept else part
            both = both.drop_duplicates(["lon", "lat"])
            kept[key] = both.iloc[hull_of(both["lon"].to_numpy(), both["lat"].to_numpy())]
    for part in kept.values():
        yield part


def convex_hull(points: DataFrame, by: str, lat: str = "lat", lon: str = "lon", fan_in: int = 256) -> DataFrame:
    """(by, ring, n) per source. One or two points give a disc of 0.1 degrees around their mean.

    Hulls are taken inside every partition, then over groups of ``fan_in`` partitions, then per source. A group sees
    hull corners only, never the points of a whole source.
    """
    placed = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(by).alias("key"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")
    )
    schema = placed.schema
    counts = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("lon").alias("mx"), F.avg("lat").alias("my"))
    partial = placed.mapInPandas(_reduce_hulls, schema)
    bundle = F.floor(F.spark_partition_id() / fan_in)
    partial = partial.withColumn("bundle", bundle).repartition("key", "bundle").select("key", "lon", "lat").mapInPandas(_reduce_hulls, schema)

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["lon", "lat"])
        corners = pdf.iloc[hull_of(pdf["lon"].to_numpy(), pdf["lat"].to_numpy())]
        ring = [{"lon": float(a), "lat": float(b)} for a, b in zip(corners["lon"], corners["lat"])]
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "ring": [ring]})

    rings = partial.groupBy("key").applyInPandas(close, f"key {dict(placed.dtypes)['key']}, ring {RING}")
    joined = counts.join(rings, "key")
    ring = F.when(F.col("n") < 3, geo.disc_ring("mx", "my", 0.1)).otherwise(F.col("ring"))
    return joined.select(F.col("key").alias(by), ring.alias("ring"), "n")


def buffer(points: DataFrame, degrees: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """A disc around every point."""
    return points.withColumn("ring", geo.disc_ring(lon, lat, degrees))


def clip_convex(subject, window):
    """The common part of two convex counter-clockwise rings (Sutherland-Hodgman); helper for a few rings."""
    result = [(p["lon"], p["lat"]) for p in subject]
    frame = [(p["lon"], p["lat"]) for p in window]
    for (ax, ay), (bx, by) in zip(frame, frame[1:] + frame[:1]):
        if not result:
            break

        def side(p):
            return (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)

        fresh = []
        for p, q in zip(result, result[1:] + result[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                fresh.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                share = sp / (sp - sq)
                fresh.append((p[0] + share * (q[0] - p[0]), p[1] + share * (q[1] - p[1])))
        result = fresh
    return [{"lon": x, "lat": y} for x, y in result]


@F.pandas_udf(RING_TYPE)
def _clip(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([clip_convex(list(p), list(q)) for p, q in zip(a, b)], dtype=object)


def _with_box(hulls: DataFrame, by: str, side: str) -> DataFrame:
    lons = F.transform("ring", lambda p: p["lon"])
    lats = F.transform("ring", lambda p: p["lat"])
    return hulls.select(
        F.col(by).alias(f"source_{side}"),
        F.col("ring").alias(f"ring_{side}"),
        F.array_min(lons).alias(f"w_{side}"),
        F.array_max(lons).alias(f"e_{side}"),
        F.array_min(lats).alias(f"s_{side}"),
        F.array_max(lats).alias(f"n_{side}"),
    )


def footprint_overlap(hulls: DataFrame, by: str = "source_key") -> DataFrame:
    """(source_a, source_b, geometry, area_km2) of each two sources whose hulls meet.

    One row per source goes in; boxes that do not meet are dropped before any clipping, by tiles (``meeting_pairs``).
    """
    a, b = _with_box(hulls, by, "a"), _with_box(hulls, by, "b")
    pairs = meeting_pairs(a, "source_a", [(F.col("w_a"), F.col("e_a")), (F.col("s_a"), F.col("n_a"))])
    met = pairs.join(a, F.col("a") == F.col("source_a")).join(b, F.col("b") == F.col("source_b"))
    clipped = met.select("source_a", "source_b", _clip("ring_a", "ring_b").alias("geometry"))
    return clipped.where(F.size("geometry") > 0).withColumn("area_km2", F.round(geo.ring_area_km2("geometry"), 2))


def time_overlap(ranges: DataFrame, by: str = "source_key") -> DataFrame:
    """(source_a, source_b, time_start, time_end, overlap_days) of each two sources whose time ranges meet."""
    times = ranges.select(F.col(by).alias("k"), "time_start", "time_end")
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("time_start", "time_end")]
    pairs = meeting_pairs(times, "k", [tuple(micros)])
    a, b = (times.select(F.col("k").alias(f"source_{s}"), F.col("time_start").alias(f"s_{s}"), F.col("time_end").alias(f"e_{s}")) for s in "ab")
    met = pairs.join(a, F.col("a") == F.col("source_a")).join(b, F.col("b") == F.col("source_b"))
    pairs = met.select("source_a", "source_b", F.greatest("s_a", "s_b").alias("time_start"), F.least("e_a", "e_b").alias("time_end"))
    days = F.floor((F.unix_micros(F.col("time_end").cast("timestamp")) - F.unix_micros(F.col("time_start").cast("timestamp"))) / 86_400_000_000).cast("bigint")
    return pairs.withColumn("overlap_days", days)


def time_overlap_totals(ranges: DataFrame, by: str = "source_key") -> DataFrame:
    """(source_a, n_later, overlap_days): ``time_overlap`` added up for each source over the later ones, without its pairs.

    Where the ends lie at different times of the day, the whole days of a pair do not follow from sums, and the pairs are made.
    ``by`` is unique.
    """
    times = stage(ranges.select(F.col(by).alias("source_a"), "time_start", "time_end"))
    low, high = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("time_start", "time_end"))
    hours = times.where(low <= high).select(F.explode(F.array(F.pmod(low, F.lit(86_400_000_000)), F.pmod(high, F.lit(86_400_000_000)))).alias("h"))
    ends = hours.agg(F.min("h").alias("a"), F.max("h").alias("z")).first()
    if ends["a"] != ends["z"]:
        pairs = time_overlap(times, "source_a")
        return pairs.groupBy("source_a").agg(F.count(F.lit(1)).alias("n_later"), F.sum("overlap_days").alias("overlap_days"))
    return later_totals(times, "source_a", low, high).withColumnRenamed("days", "overlap_days")


def spacetime_overlap(hulls: DataFrame, ranges: DataFrame, by: str = "source_key") -> DataFrame:
    """Pairs of sources that overlap in space or in time, with both measures; a pair without common area has no
    geometry. Only sources with a hull take part."""
    space = footprint_overlap(hulls, by)
    placed = hulls.select(F.col(by).alias("k"))
    time = time_overlap(ranges.join(placed, ranges[by] == placed["k"], "left_semi"), by)
    both = space.join(time, ["source_a", "source_b"], "full")
    return both.select(
        "source_a",
        "source_b",
        "geometry",
        F.coalesce("area_km2", F.lit(0.0)).alias("area_km2"),
        F.col("geometry").isNotNull().alias("spatial_overlap"),
        F.col("time_start").isNotNull().alias("temporal_overlap"),
        F.coalesce("overlap_days", F.lit(0)).alias("overlap_days"),
        iso_date("time_start").alias("time_start"),
        iso_date("time_end").alias("time_end"),
    )


def layer_relationships(overlaps: DataFrame) -> DataFrame:
    """Edges between sources: (source_a, source_b, kind, weight) from a space-time overlap (choice ours)."""
    kinds = F.array(
        F.struct(F.lit("space").alias("kind"), F.when(F.col("spatial_overlap"), F.col("area_km2")).alias("weight")),
        F.struct(F.lit("time").alias("kind"), F.when(F.col("temporal_overlap"), F.col("overlap_days").cast("double")).alias("weight")),
    )
    return overlaps.select("source_a", "source_b", F.inline(kinds)).where("weight IS NOT NULL")


# ---------------------------------------------------------------- polygons


def _tile(value, level):
    """Tile number along one axis at a level: 360 degrees in 2^level tiles."""
    return F.floor((value + 180.0) * F.pow(F.lit(2.0), level) / 360.0).cast("bigint")


#: Rings of more edges than this are cut into bands.
RING_EDGES = 64
_FINEST_BAND = -30


def _bands(polygons: DataFrame, polygon_id: str, ring: str, holes: str | None) -> DataFrame:
    """(id, ``__v``, ``__band``, ``__edges``): the edges of polygons by bands of latitude.

    An edge is filed at the level (a power of two of degrees) of its height, where it spans two bands at most, so a ring's
    copies grow with its edges whatever its shape.
    """
    edges = F.flatten(F.transform(F.concat(F.array(ring), F.coalesce(holes, F.array().cast(f"array<{RING}>"))) if holes else F.array(ring), geo.edges))
    each = polygons.select(F.col(polygon_id).alias("__pid"), F.explode(edges).alias("__e"))
    low, high = F.least("__e.p.lat", "__e.q.lat"), F.greatest("__e.p.lat", "__e.q.lat")
    level = F.greatest(F.ceil(F.log2(F.greatest(high - low, F.lit(2.0**_FINEST_BAND)))), F.lit(_FINEST_BAND)).cast("int")
    width = F.pow(F.lit(2.0), level)
    tall = each.where(low < high).withColumn("__v", level)
    filed = tall.withColumn("__band", F.explode(F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))))
    return filed.groupBy("__pid", "__v", "__band").agg(F.collect_list("__e").alias("__edges"))


def spatial_join(
    points: DataFrame,
    polygons: DataFrame,
    polygon_id: str,
    lat: str = "latitude",
    lon: str = "longitude",
    ring: str = "ring",
    holes: str | None = None,
) -> DataFrame:
    """Points beside the polygons that contain them; ``polygon_id`` is unique, ``holes`` names a column of rings to leave out.

    Each polygon is filed at the tile level where it spans at most two tiles each way, so it takes up to four tiles
    whatever its size, and a point looks in one tile per level in use. The ray test runs on tile mates only. A polygon
    of many edges is cut into bands, and a tile mate meets only the edges of its own band at each height in use.
    """
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    count = F.size(ring) + (F.aggregate(F.coalesce(holes, F.array().cast(f"array<{RING}>")), F.lit(0), lambda n, h: n + F.size(h)) if holes else F.lit(0))
    boxed = polygons.select(
        F.col(polygon_id),
        F.col(ring).alias("__ring"),
        *([F.col(holes).alias("__holes")] if holes else []),
        F.array_min(lons).alias("__w"), F.array_max(lons).alias("__e"),
        F.array_min(lats).alias("__s"), F.array_max(lats).alias("__n"),
        (count > RING_EDGES).alias("__large"),
    )
    widest = F.greatest(F.col("__e") - F.col("__w"), F.col("__n") - F.col("__s"), F.lit(360.0 / (1 << 20)))
    level = F.least(F.lit(20), F.greatest(F.lit(0), F.floor(F.log2(F.lit(360.0) / widest)).cast("int")))
    filed = boxed.withColumn("__level", level)
    levels = sorted(r["__level"] for r in filed.select("__level").distinct().collect() if r["__level"] is not None)
    tiles = filed.withColumn("__tx", F.explode(F.sequence(_tile(F.col("__w"), F.col("__level")), _tile(F.col("__e"), F.col("__level")))))
    tiles = tiles.withColumn("__ty", F.explode(F.sequence(_tile(F.col("__s"), F.col("__level")), _tile(F.col("__n"), F.col("__level")))))
    looks = F.explode(F.array(*[F.lit(v) for v in levels] or [F.lit(-1)]))
    x, y = F.col(lon), F.col(lat)

    def mates(left: DataFrame, right: DataFrame, test) -> DataFrame:
        spread = left.withColumn("__level", looks)
        spread = spread.withColumns({"__tx": _tile(x, F.col("__level")), "__ty": _tile(y, F.col("__level"))})
        in_box = x.between(F.col("__w"), F.col("__e")) & y.between(F.col("__s"), F.col("__n"))
        same = (spread["__level"] == right["__level"]) & (spread["__tx"] == right["__tx"]) & (spread["__ty"] == right["__ty"])
        return spread.join(right, same & in_box & test).select(*[spread[c] for c in left.columns], right[polygon_id])

    inside = geo.ring_contains("__ring", x, y)
    if holes:
        inside = inside & ~F.exists(F.coalesce("__holes", F.array().cast(f"array<{RING}>")), lambda h: geo.ring_contains(h, x, y))
    small = mates(points, tiles.where("NOT __large"), inside)
    if boxed.where("__large").isEmpty():
        return small
    placed = stage(points.withColumn("__row", F.monotonically_increasing_id()))
    near = mates(placed.select("__row", lat, lon), tiles.where("__large").drop("__ring"), F.lit(True))
    large = polygons.where(count > RING_EDGES)
    bands = stage(_bands(large, polygon_id, ring, holes))
    heights = bands.groupBy(F.col("__pid").alias("__of")).agg(F.collect_set("__v").alias("__vs"))
    asked = near.join(heights, F.col(polygon_id) == F.col("__of")).withColumn("__at", F.explode("__vs"))
    asked = asked.withColumn("__y", F.floor(y / F.pow(F.lit(2.0), "__at")).cast("long"))
    met = asked.join(bands, (F.col("__of") == F.col("__pid")) & (F.col("__at") == F.col("__v")) & (F.col("__y") == F.col("__band")))
    crossed = met.groupBy("__row", "__pid").agg(F.sum(geo.crossings("__edges", x, y)).alias("__n")).where("__n % 2 = 1")
    hits = placed.join(crossed, "__row").select(*[placed[c] for c in points.columns], F.col("__pid").alias(polygon_id))
    return small.unionByName(hits)


def polygon_filter(points: DataFrame, polygons: DataFrame, polygon_id: str, row_id: str, **columns) -> DataFrame:
    """The points inside any of the polygons, each once."""
    hits = spatial_join(points, polygons, polygon_id, **columns)
    return hits.drop(polygon_id).dropDuplicates([row_id])


def map_points(obs: DataFrame, n: int, row_id: str = "id") -> DataFrame:
    """Up to ``n`` display points of each source with a label, in hash order."""
    from regionloom.functions.scalars import title_label
    from regionloom.operators.tables import limit_per_source

    placed = obs.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    shown = limit_per_source(placed, n, row_id)
    return shown.select(row_id, "source_key", title_label("source_key").alias("label"), "latitude", "longitude")

