"""Writers. All of them write in parallel; none gathers rows on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from regionloom.operators.filters import filter_observations


def write_csv(df: DataFrame, path: str, mode: str = "error", partition_by=()) -> None:
    df.write.mode(mode).option("header", True).partitionBy(*partition_by).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error", partition_by=()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).json(path)


def export_observations(observations: DataFrame, filters: dict, path: str, mode: str = "error") -> None:
    """CSV of the filtered observation table, one folder per source."""
    write_csv(filter_observations(observations, **filters), path, mode, partition_by=["source_key"])


def split_write(df: DataFrame, by: str, path: str, mode: str = "error") -> None:
    """One folder per value of ``by``, whatever the number of values."""
    df.write.mode(mode).partitionBy(by).parquet(path)


# Header of the profile file.
PROFILE_HEADER = {
    "name": "Column Name",
    "inferred_type": "Inferred Type",
    "inferred_unit_tag": "Unit/Tag",
    "null_count": "Null Count",
    "unique_values": "Unique Values",
    "human_description": "Human Description",
}


def profile_table(profile: DataFrame) -> DataFrame:
    """The profile under its file header; missing tag and description are empty text."""
    filled = profile
    if "human_description" not in profile.columns:
        filled = filled.withColumn("human_description", F.lit(None).cast("string"))
    filled = filled.fillna("", subset=["inferred_unit_tag", "human_description"])
    return filled.select([F.col(c).alias(title) for c, title in PROFILE_HEADER.items()])


def write_profile(profile: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    if fmt == "csv":
        write_csv(profile_table(profile), path, mode)
    else:
        write_json(profile, path, mode)


def overlap_summary(pairs: DataFrame) -> DataFrame:
    """Pairs with the largest shared area first, without geometry."""
    columns = [c for c in pairs.columns if c not in ("geometry", "ring")]
    return pairs.select(columns).orderBy(F.desc("area_km2"), "source_a", "source_b")


def write_overlap_summary(pairs: DataFrame, path: str, mode: str = "error") -> None:
    write_csv(overlap_summary(pairs), path, mode)
