"""Fixed schemas and small driver-side descriptions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source_key", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("dataset_category", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("county", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
    ]
)

RING = "array<struct<lon:double,lat:double>>"
RING_TYPE = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


@dataclass(frozen=True)
class SourceDefinition:
    """One registered source: where it is and which columns may hold place and time."""

    key: str
    name: str
    category: str = ""
    connector_type: str = "csv"
    source_url: str = ""
    notes: str = ""
    requires_download: bool = False
    latitude_fields: tuple[str, ...] = ("latitude", "lat", "LATITUDE")
    longitude_fields: tuple[str, ...] = ("longitude", "lon", "LONGITUDE")
    year_fields: tuple[str, ...] = ("year", "fireyear")
    county_fields: tuple[str, ...] = ("county", "county_name")


@dataclass(frozen=True)
class SpaceTimeKey:
    """The columns that place a row in space and time."""

    latitude: str = "latitude"
    longitude: str = "longitude"
    time: str | None = None
    crs: str = "EPSG:4326"
    extra: dict = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [c for c in (self.latitude, self.longitude, self.time) if c]
