"""Row filters and predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from regionloom.functions import geo
from regionloom.functions.scalars import as_col, to_numeric

_COMPARISONS = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
}


def compare(c, op: str, value) -> Column:
    """``== != > < >= <=`` where a missing value is unequal to everything; an unknown sign keeps all rows."""
    c, v = as_col(c), F.lit(value)
    if op == "==":
        return F.coalesce(c == v, F.lit(False))
    if op == "!=":
        return ~F.coalesce(c == v, F.lit(False))
    if op in _COMPARISONS:
        return F.coalesce(_COMPARISONS[op](c, v), F.lit(False))
    return F.lit(True)


def apply_op(df: DataFrame, c: str, op: str, value) -> DataFrame:
    return df.where(compare(c, op, value))


def where(df: DataFrame, predicate: str) -> DataFrame:
    return df.where(F.expr(predicate))


def remove_where(df: DataFrame, predicate: str) -> DataFrame:
    """Drop the rows for which the predicate is true; rows where it is unknown stay."""
    return df.where(~F.coalesce(F.expr(predicate), F.lit(False)))


def between(df: DataFrame, c: str, low: float, high: float) -> DataFrame:
    """Inclusive numeric range; a numeric column is compared as it is, so that the scan can use it."""
    numeric = dict(df.dtypes)[c] in ("double", "float", "int", "bigint", "smallint", "tinyint")
    value = F.col(c) if numeric else to_numeric(c)
    return df.where(value.between(low, high))


def parse_radius(radius) -> float:
    """Kilometres from a number or a text such as ``50mi`` or ``200km``."""
    if isinstance(radius, (int, float)):
        return float(radius)
    found = re.fullmatch(r"\s*([0-9.]+)\s*(km|mi|m)?\s*", radius.lower())
    if not found:
        raise ValueError(f"not a radius: {radius!r}")
    size, unit = float(found.group(1)), found.group(2) or "km"
    return {"km": size, "mi": size / geo.MILES_PER_KM, "m": size / 1000.0}[unit]


def near(
    df: DataFrame,
    centre: tuple[float, float],
    radius,
    lat: str = "latitude",
    lon: str = "longitude",
    earth: float = geo.EARTH_KM,
) -> DataFrame:
    """Rows within a radius (km, or a text with its unit). Rows without a place go; a table without place
    columns is returned whole."""
    if lat not in df.columns or lon not in df.columns:
        return df
    kinds = dict(df.dtypes)
    place = [F.col(c) if kinds[c] in ("double", "float") else to_numeric(c) for c in (lat, lon)]
    return df.where(geo.in_radius(place[0], place[1], centre, parse_radius(radius), earth))


def bbox(df: DataFrame, xmin, ymin, xmax, ymax, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.where(F.col(lon).between(xmin, xmax) & F.col(lat).between(ymin, ymax))


def filter_observations(
    df: DataFrame,
    source_key=None,
    county=None,
    city=None,
    category=None,
    year_min=None,
    year_max=None,
    centre=None,
    radius_km=None,
    limit=None,
) -> DataFrame:
    """All given conditions together; a condition that is None or empty text is ignored."""
    equal = {"source_key": source_key, "county": county, "city": city, "dataset_category": category}
    for column, value in equal.items():
        if value not in (None, ""):
            df = df.where(F.col(column) == value)
    if year_min not in (None, ""):
        df = df.where(F.col("year") >= int(year_min))
    if year_max not in (None, ""):
        df = df.where(F.col("year") <= int(year_max))
    if centre is not None and radius_km not in (None, ""):
        df = near(df, centre, radius_km)
    return df if limit is None else df.limit(limit)
