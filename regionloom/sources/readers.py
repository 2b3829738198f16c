"""Readers for landed files. Nothing is fetched from a network here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from regionloom.functions.scalars import header_row_map
from regionloom.sources.archives import ZippedCsv

BAD_RECORD = "_bad_record"


def read_csv(spark: SparkSession, path, schema: T.StructType | str | None = None, keep_bad: bool = False) -> DataFrame:
    """CSV with a header. Give a schema: inference costs one more pass over the files."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if keep_bad:
        schema = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", BAD_RECORD)
    return reader.schema(schema).csv(path)


def _documents(spark: SparkSession, path, schema, per_line: bool) -> DataFrame:
    reader = spark.read.option("multiLine", not per_line)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_geojson(spark: SparkSession, path, schema=None, per_line: bool = False) -> DataFrame:
    """Feature collections: one row per feature, its properties as columns and ``geometry``.

    ``per_line`` reads newline-delimited features, which Spark can split; a single document cannot be split.
    """
    raw = _documents(spark, path, schema, per_line)
    features = raw if per_line and "features" not in raw.columns else raw.select(F.inline_outer("features"))
    return features.select("properties.*", "geometry")


def read_arcgis_pages(spark: SparkSession, path, schema=None, per_line: bool = False) -> DataFrame:
    """Landed query pages of a feature service: attributes plus longitude and latitude."""
    raw = _documents(spark, path, schema, per_line)
    features = raw.select(F.explode("features").alias("f"))
    return features.select(
        "f.attributes.*", F.col("f.geometry.x").alias("longitude"), F.col("f.geometry.y").alias("latitude")
    )


def read_json_payloads(spark: SparkSession, path, record_path: str | None = None, schema=None, per_line=False) -> DataFrame:
    """Web payloads: the array of records at ``record_path`` (dotted), or the documents themselves."""
    raw = _documents(spark, path, schema, per_line)
    if not record_path:
        return raw
    return raw.select(F.explode(F.col(record_path)).alias("r")).select("r.*")


def read_header_arrays(spark: SparkSession, path, per_line: bool = False) -> DataFrame:
    """Payloads of the form ``[[names...],[values...]]``: one map column ``record`` per file, or ``per_line``."""
    text = spark.read.text(path, wholetext=not per_line)
    return parse_header_arrays(text, "value")


def parse_header_arrays(df: DataFrame, column: str) -> DataFrame:
    parsed = F.from_json(F.col(column), "array<array<string>>")
    return df.select(header_row_map(parsed).alias("record"))


def read_zipped_csv(spark: SparkSession, path: str, schema: T.StructType | str, members: str = "*.csv") -> DataFrame:
    """CSV members of the ZIP archives in a folder (or of a pattern of names), a partition for each member (``archives``).

    A value that is no value of its column's type is NULL.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    spark.dataSource.register(ZippedCsv)
    text = T.StructType([T.StructField(n, T.StringType()) for n in schema.names])
    rows = spark.read.format("zipped_csv").schema(text).option("path", str(path)).option("members", members).load()
    return rows.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def fetch(
    tables: dict[str, DataFrame], source_keys: list[str] | None = None, limit: int | None = None, order_by: dict[str, str] | None = None
) -> DataFrame:
    """The first ``limit`` rows of each chosen table (by its column in ``order_by``, else any), bound together with
    ``__source__``."""
    keys = [k for k in (source_keys or list(tables)) if k in tables]
    parts = []
    for key in keys:
        part = tables[key].orderBy(order_by[key]) if order_by and limit is not None else tables[key]
        part = part if limit is None else part.limit(limit)
        parts.append(part.withColumn("__source__", F.lit(key)))
    if not parts:
        raise ValueError(f"none of {source_keys or 'the tables'} is there")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
