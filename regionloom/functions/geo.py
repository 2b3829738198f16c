"""Geographic column functions: native Spark expressions, and Arrow batches for rings of many corners."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

# Earth radii in use, and the flat conversions.
EARTH_KM = 6371.0088
EARTH_KM_ROUND = 6371.0
EARTH_MILES = 3958.8
MILES_PER_KM = 0.621371
METRES_PER_MILE = 1609.34
KM_PER_DEGREE = 111.0
MILES_PER_DEGREE = 69.0


def _col(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def _known(c) -> Column:
    """A coordinate; NaN is missing. (In Spark NaN is larger than any number, so it would pass comparisons.)"""
    return F.when(~F.isnan(_col(c)), _col(c)) if isinstance(c, (Column, str)) else _col(c)


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the unit of ``radius``; NULL where a coordinate is NULL or NaN. Arguments: columns, column
    names or numbers."""
    a1, o1, a2, o2 = (_known(c) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(a2 - a1) / 2)
    half_lon = F.sin(F.radians(o2 - o1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * half_lon * half_lon
    # not least(): it passes over NULL
    return F.asin(F.sqrt(F.when(h > 1.0, 1.0).otherwise(h))) * (2.0 * radius)


def km_to_miles(c) -> Column:
    return _col(c) * MILES_PER_KM


def miles_to_km(c) -> Column:
    return _col(c) / MILES_PER_KM


def miles_to_metres(c) -> Column:
    return _col(c) * METRES_PER_MILE


def degrees_to_km(c) -> Column:
    return _col(c) * KM_PER_DEGREE


def degrees_to_miles(c, lat=None) -> Column:
    """Degrees to miles; with ``lat`` given, degrees of longitude at that latitude."""
    flat = _col(c) * MILES_PER_DEGREE
    return flat if lat is None else flat * F.cos(F.radians(_col(lat)))


def bounding_box(lat: float, lon: float, radius: float, earth: float = EARTH_KM):
    """(south, north, west, east) of a disc. ``west is None`` when every longitude is possible;
    ``west > east`` when the disc crosses the date line."""
    reach = math.degrees(radius / earth)
    south, north = lat - reach, lat + reach
    if south <= -90 or north >= 90:
        return max(south, -90.0), min(north, 90.0), None, None
    width = math.degrees(math.asin(min(1.0, math.sin(radius / earth) / math.cos(math.radians(lat)))))
    if radius / earth >= math.pi / 2 or width >= 180:
        return south, north, None, None
    west, east = lon - width, lon + width
    if west < -180:
        west += 360
    if east > 180:
        east -= 360
    return south, north, west, east


def in_radius(lat, lon, centre: tuple[float, float], radius: float, earth: float = EARTH_KM) -> Column:
    """Disc test. The box conjuncts come first, so that file statistics can skip data."""
    lat, lon = _col(lat), _col(lon)
    south, north, west, east = bounding_box(centre[0], centre[1], radius, earth)
    slack = 1e-9
    test = lat.between(south - slack, north + slack)
    if west is not None:
        if west <= east:
            test = test & lon.between(west - slack, east + slack)
        else:
            test = test & ((lon >= west - slack) | (lon <= east + slack))
    return test & (haversine(lat, lon, centre[0], centre[1], earth) <= radius)


def point(lon, lat) -> Column:
    return F.struct(_col(lon).alias("lon"), _col(lat).alias("lat"))


def point_geojson(lon, lat) -> Column:
    """``{"type":"Point","coordinates":[lon,lat]}`` as a JSON string."""
    return F.to_json(
        F.struct(F.lit("Point").alias("type"), F.array(_col(lon), _col(lat)).alias("coordinates"))
    )


def point_from_geojson(c) -> Column:
    parsed = F.from_json(_col(c), "type string, coordinates array<double>")
    pair = parsed["coordinates"]
    return F.when(
        (parsed["type"] == "Point") & (F.size(pair) >= 2),
        F.struct(F.get(pair, F.lit(0)).alias("lon"), F.get(pair, F.lit(1)).alias("lat")),
    )


def disc_ring(lon, lat, degrees, corners: int = 64) -> Column:
    """A disc of a radius in degrees as a counter-clockwise ring (not closed)."""
    lon, lat, size = _col(lon), _col(lat), _col(degrees)
    angles = [2 * math.pi * i / corners for i in range(corners)]
    # a constant array: written out corner by corner, the generated method is too long for the JVM to compile
    ways = F.array(*[F.struct(F.lit(math.cos(a)).alias("x"), F.lit(math.sin(a)).alias("y")) for a in angles])
    return F.transform(ways, lambda w: F.struct((lon + size * w["x"]).alias("lon"), (lat + size * w["y"]).alias("lat")))


def radius_outline(lat, lon, miles) -> Column:
    """Circle of a radius in miles as 361 points (first point repeated), flat 69 miles per degree."""
    lat, lon, size = _col(lat), _col(lon), _col(miles) / MILES_PER_DEGREE
    return F.transform(
        F.sequence(F.lit(0), F.lit(360)),
        lambda i: F.struct(
            (lon + size / F.cos(F.radians(lat)) * F.cos(F.radians(i))).alias("lon"),
            (lat + size * F.sin(F.radians(i))).alias("lat"),
        ),
    )


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    following = F.when(n > 0, F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)))
    return F.zip_with(ring, following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _corners(rings: pa.Array) -> tuple[np.ndarray, ...]:
    """Row of each corner, place of the corner that follows it in its ring, longitude, latitude, and whether one is missing."""
    size = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(rings)), size)
    following = np.arange(1, len(row) + 1)
    end = np.cumsum(size)
    following[end[size > 0] - 1] = (end - size)[size > 0]
    points = rings.flatten()
    lon, lat = (pc.struct_field(points, name).cast(pa.float64()) for name in ("lon", "lat"))
    missing = pc.or_(lon.is_null(), lat.is_null()).to_numpy(zero_copy_only=False)
    return row, following, *(np.where(missing, np.nan, c.to_numpy(zero_copy_only=False)) for c in (lon, lat)), missing


@F.arrow_udf(T.DoubleType())
def _area(rings: pa.Array) -> pa.Array:
    row, following, lon, lat, missing = _corners(rings)
    size = np.bincount(row, minlength=len(rings))
    first = np.repeat(np.cumsum(size) - size, size)
    x, y = lon - lon[first], lat - lat[first]
    twice = np.bincount(row, x * y[following] - x[following] * y, minlength=len(rings))
    area = np.where(size >= 3, np.abs(twice) / 2, 0.0)
    unknown = (np.bincount(row, missing, minlength=len(rings)) > 0) & (size >= 3)
    return pa.array(area, mask=rings.is_null().to_numpy(zero_copy_only=False) | unknown)


@F.arrow_udf(T.BooleanType())
def _contains(rings: pa.Array, lon: pa.Array, lat: pa.Array) -> pa.Array:
    row, following, x, y, missing = _corners(rings)
    east, north = (c.cast(pa.float64()).to_numpy(zero_copy_only=False)[row] for c in (lon, lat))
    with np.errstate(invalid="ignore", divide="ignore"):
        spans = ((y > north) != (y[following] > north)) & ~missing & ~missing[following]
        crossed = spans & (east < x + (north - y) / (y[following] - y) * (x[following] - x))
    inside = np.bincount(row, crossed, minlength=len(rings)).astype(np.int64) % 2 == 1
    return pa.array(inside, mask=np.bincount(row, minlength=len(rings)) == 0)  # no ring, or no corner


def ring_area(ring) -> Column:
    """Unsigned shoelace area in square degrees; the first corner is the origin to keep digits. Rings go through Arrow in batches."""
    return _area(_col(ring))


def ring_area_km2(ring, latitude_aware: bool = False) -> Column:
    """Square degrees x 111 squared; ``latitude_aware`` also narrows by the cosine of the mean latitude."""
    ring = _col(ring)
    flat = ring_area(ring) * (KM_PER_DEGREE**2)
    if not latitude_aware:
        return flat
    mean_lat = F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p["lat"]) / F.size(ring)
    return flat * F.cos(F.radians(mean_lat))


def edges(ring) -> Column:
    """The edges of a ring, from each corner (``p``) to the next (``q``)."""
    return _edges(_col(ring))


def crossings(edge_list, lon, lat) -> Column:
    """How many of the edges a ray to the east crosses."""
    edge_list, lon, lat = _col(edge_list), _col(lon), _col(lat)

    def crosses(e):
        p, q = e["p"], e["q"]
        spans = (p["lat"] > lat) != (q["lat"] > lat)
        at = p["lon"] + (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) * (q["lon"] - p["lon"])
        return F.when(spans & (lon < at), 1).otherwise(0)

    return F.aggregate(edge_list, F.lit(0), lambda acc, e: acc + crosses(e))


def ring_contains(ring, lon, lat) -> Column:
    """Even-odd ray casting, one native expression per row."""
    return (crossings(edges(ring), lon, lat) % 2) == 1


def rings_contain(ring, lon, lat) -> Column:
    """``ring_contains`` for rings of many corners: Arrow batches in place of functions on arrays, which Spark does not compile."""
    return _contains(_col(ring), _col(lon), _col(lat))


def unit_vector(lat, lon) -> list[Column]:
    """The point on the unit sphere; straight-line distance there grows with great-circle distance."""
    lat, lon = F.radians(_col(lat)), F.radians(_col(lon))
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]
