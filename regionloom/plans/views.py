"""Observation and event tables derived from the relational test tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from regionloom.functions.geo import EARTH_KM

CENTRE = (42.5, -121.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(key: str, factor: int, base: float):
    return (F.col(key) * factor % 10000) / F.lit(1e4) + F.lit(base)


def located(df: DataFrame, key: str) -> DataFrame:
    """Place columns from an id, by fixed arithmetic."""
    return df.withColumns({"latitude": _spread(key, 7919, 42.0), "longitude": _spread(key, 104729, -122.0)})


def located_sql(key: str) -> str:
    return (
        f"(({key} * 7919) % 10000) / CAST(10000 AS DOUBLE) + CAST(42 AS DOUBLE) AS latitude, "
        f"(({key} * 104729) % 10000) / CAST(10000 AS DOUBLE) + CAST(-122 AS DOUBLE) AS longitude"
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = located(table(spark, sf_dir, "orders"), "o_orderkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        places, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("source_key"),
        F.col("o_orderpriority").alias("source_name"),
        F.col("r_name").alias("dataset_category"),
        F.year("o_orderdate").alias("year"),
        F.col("n_name").alias("county"),
        F.col("c_mktsegment").alias("city"),
        "latitude",
        "longitude",
        F.lit("total_price").alias("metric_name"),
        F.col("o_totalprice").alias("metric_value"),
    )


OBS = f"""obs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS source_key, o_orderpriority AS source_name,
         r_name AS dataset_category, CAST(year(o_orderdate) AS INTEGER) AS year, n_name AS county, c_mktsegment AS city,
         {located_sql('o_orderkey')}, 'total_price' AS metric_name, o_totalprice AS metric_value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(table(spark, sf_dir, "events"), "event_id").select(
        "event_id", F.col("event_type").alias("source_key"), "ts", "user_id", "value", "props", "latitude", "longitude"
    )


EV = f"""ev AS (SELECT event_id, event_type AS source_key, ts, user_id, value, props, {located_sql('event_id')} FROM events)"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = EARTH_KM) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
        f"pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"(asin(sqrt(least(1.0, {a}))) * {2 * radius!r})"


def distance_sql(radius: float = EARTH_KM) -> str:
    return haversine_sql("latitude", "longitude", f"CAST({CENTRE[0]} AS DOUBLE)", f"CAST({CENTRE[1]} AS DOUBLE)", radius)


def with_distance(df: DataFrame) -> DataFrame:
    from regionloom.functions.geo import haversine

    return df.withColumn("distance_km", haversine("latitude", "longitude", *CENTRE))
