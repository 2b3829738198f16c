"""Equi joins and small lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from regionloom.functions.scalars import blank_to_null


def join_sources(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Equi join (inner, left, right, full, left_semi, left_anti). Adaptive execution picks broadcast by
    measured size and splits skewed partitions."""
    return left.join(right, on, how)


def describe_columns(profile: DataFrame, dictionary: DataFrame, context: dict[str, str] | None = None) -> DataFrame:
    """Human description per profile row: from the dictionary, else from the context map, else empty."""
    context = context or {}
    words = dictionary.groupBy(F.col("field_name").alias("name")).agg(F.min("description").alias("__text"))
    fallback = F.lit("")
    if context:
        pairs = [F.lit(x) for kv in context.items() for x in kv]
        fallback = F.coalesce(F.element_at(F.create_map(*pairs), F.col("name")), F.lit(""))
    joined = profile.join(words, "name", "left")
    return joined.withColumn("human_description", F.coalesce(blank_to_null("__text"), fallback)).drop("__text")


def centroid_fallback(df: DataFrame, county: str, centroids: DataFrame) -> DataFrame:
    """One point per distinct county that has a known centroid (county, lat, lon)."""
    names = df.select(F.col(county).alias("county")).where(F.col("county").isNotNull()).distinct()
    return names.join(centroids.select("county", "lat", "lon"), "county")
