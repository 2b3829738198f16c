"""Grouped summaries of observation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from regionloom.functions import geo
from regionloom.functions.scalars import days_between, known, to_numeric, to_time
from regionloom.operators.columns import attach
from regionloom.operators.positions import number_rows
from regionloom.operators.quantiles import exact_quantiles
from regionloom.session import stage


def aggregate_source(df: DataFrame, group_by: list[str], value: str = "metric_value", source_key: str | None = None) -> DataFrame:
    """count, sum, mean, min and max of ``value`` per group (choice of statistics ours)."""
    if source_key is not None:
        df = df.where(F.col("source_key") == source_key)
    v = known(value)
    return df.groupBy(*group_by).agg(
        F.count(v).alias(f"{value}_count"),
        F.sum(v).alias(f"{value}_sum"),
        F.avg(v).alias(f"{value}_mean"),
        F.min(v).alias(f"{value}_min"),
        F.max(v).alias(f"{value}_max"),
    )


def county_compare(df: DataFrame, value: str = "metric_value") -> DataFrame:
    """Rows, sum and mean per county, most rows first; only rows when there is no metric column."""
    aggregates = [F.count(F.lit(1)).alias("observation_count")]
    if value in df.columns:
        aggregates += [F.coalesce(F.sum(known(value)), F.lit(0.0)).alias("metric_sum"), F.avg(known(value)).alias("metric_mean")]
    return df.groupBy("county").agg(*aggregates).orderBy(F.desc("observation_count"), "county")


def distance_stats(df: DataFrame, by: str = "source_key", distance: str = "distance_km") -> DataFrame:
    """(by, stat, distance) with count, mean, median, min and max of the distances of each source."""
    d = F.col(distance)
    measured = stage(df.where(d.isNotNull() & ~F.isnan(d)).select(by, distance))
    plain = measured.groupBy(by).agg(
        F.count(d).cast("double").alias("count"), F.avg(d).alias("mean"), F.min(d).alias("min"), F.max(d).alias("max")
    )
    medians = exact_quantiles(measured, distance, [0.5], by=[by]).select(by, F.col("value").alias("median"))
    wide = plain.join(medians, by).select(by, "count", "mean", "median", "min", "max")
    return wide.unpivot([by], ["count", "mean", "median", "min", "max"], "stat", distance)


def pivot_stats(stats: DataFrame, by: str = "source_key", value: str = "distance_km") -> DataFrame:
    """Source by statistic, holes 0."""
    names = ["count", "mean", "median", "min", "max"]
    return stats.groupBy(by).pivot("stat", names).agg(F.avg(value)).fillna(0.0, subset=names)


def _together(parts: list[DataFrame], schema: str) -> DataFrame:
    """All parts, or an empty table."""
    return reduce(DataFrame.unionByName, parts) if parts else SparkSession.active().createDataFrame([], schema)


def load_report(tables: dict[str, DataFrame], centre, radius_km: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows, rows within the radius, columns and status per table; one pass over each."""
    parts = []
    for key, table in tables.items():
        inside = geo.in_radius(lat, lon, centre, radius_km) if {lat, lon} <= set(table.columns) else F.lit(True)
        counted = table.agg(F.count(F.lit(1)).alias("rows_total"), F.count_if(inside).alias("rows_in_radius"))
        parts.append(
            counted.select(
                F.lit(key).alias("source_key"),
                "rows_total",
                "rows_in_radius",
                F.lit(len(table.columns)).alias("columns"),
                F.when(F.col("rows_total") == 0, "empty").otherwise("ok").alias("status"),
            )
        )
    return _together(parts, "source_key string, rows_total long, rows_in_radius long, columns int, status string")


def trend(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Least-squares slope, intercept and r2 per group; NULL below two distinct x."""
    keep = known(F.col(x).cast("double")).isNotNull() & known(F.col(y).cast("double")).isNotNull()
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    enough = F.min(x) < F.max(x)
    return (
        df.where(keep)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.when(enough, F.regr_slope(ys, xs)).alias("slope"),
            F.when(enough, F.regr_intercept(ys, xs)).alias("intercept"),
            F.when(enough, F.regr_r2(ys, xs)).alias("r2"),
        )
    )


def conditional_mean_curve(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of y at each distinct x, in order of x."""
    both = df.where(known(x).isNotNull() & known(y).isNotNull())
    return both.groupBy(x).agg(F.avg(y).alias(f"{y}_mean")).orderBy(x)


def time_ranges(tables: dict[str, DataFrame], candidates: dict[str, list[str]]) -> DataFrame:
    """(source_key, column, start, end) of the first candidate column with at least two dates; one pass each."""
    parts = []
    for key, table in tables.items():
        kinds = dict(table.dtypes)
        columns = [c for c in candidates.get(key, []) if c in kinds]
        if not columns:
            continue
        times = [F.col(c) if kinds[c] in ("timestamp", "timestamp_ntz", "date") else to_time(c) for c in columns]
        found = table.agg(
            *[
                F.when(
                    F.count(t) >= 2,
                    F.struct(
                        F.lit(c).alias("column"),
                        F.min(t).cast("timestamp").alias("time_start"),
                        F.max(t).cast("timestamp").alias("time_end"),
                    ),
                ).alias(f"r_{i}")
                for i, (c, t) in enumerate(zip(columns, times))
            ]
        )
        first = F.coalesce(*[F.col(f"r_{i}") for i in range(len(columns))])
        parts.append(found.select(F.lit(key).alias("source_key"), first.alias("r")).where("r IS NOT NULL").select("source_key", "r.*"))
    return _together(parts, "source_key string, column string, time_start timestamp, time_end timestamp")


def time_ranges_by(df: DataFrame, time: str, by: str = "source_key") -> DataFrame:
    """The same for one table that holds all sources: (by, time_start, time_end) where two dates exist."""
    t = F.col(time)
    return (
        df.groupBy(by)
        .agg(F.count(t).alias("n"), F.min(t).alias("time_start"), F.max(t).alias("time_end"))
        .where("n >= 2")
        .drop("n")
    )


def compare_datasets(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    if keys:
        obs = obs.where(F.col("source_key").isin(keys))
    return obs.groupBy("source_key").agg(F.count(F.lit(1)).alias("row_count"), F.avg(known("metric_value")).alias("metric_mean"))


def dataset_trends(obs: DataFrame) -> DataFrame:
    return obs.groupBy("source_key", "year").agg(F.avg(known("metric_value")).alias("metric_mean"))


def county_counts(obs: DataFrame) -> DataFrame:
    """Rows per county, nameless ones as ``Unknown``, most rows first."""
    name = F.coalesce(F.nullif(F.col("county"), F.lit("")), F.lit("Unknown")).alias("county")
    return obs.groupBy(name).agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.desc("row_count"), "county")


def sankey_links(obs: DataFrame, levels=("source_key", "dataset_category", "county", "metric_name")) -> DataFrame:
    """Flows between neighbouring levels: (level, source, target, value, source_id, target_id), value = rows.

    The rows are first counted per combination of levels, then each combination gives its links.
    """
    filled = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown")).alias(c) for c in levels]
    combos = obs.select(*filled).groupBy(*levels).agg(F.count(F.lit(1)).alias("n"))
    links = F.array(
        *[
            F.struct(F.lit(i).alias("level"), F.col(a).alias("source"), F.col(b).alias("target"))
            for i, (a, b) in enumerate(zip(levels, levels[1:]))
        ]
    )
    flows = combos.select("n", F.inline(links)).groupBy("level", "source", "target").agg(F.sum("n").alias("value"))
    nodes = flows.select("level", F.col("source").alias("node")).union(
        flows.select(F.col("level") + 1, F.col("target"))
    ).distinct()
    ids = number_rows(nodes, ["level", "node"], name="node_id")
    a = ids.select("level", F.col("node").alias("source"), F.col("node_id").alias("source_id"))
    b = ids.select((F.col("level") - 1).alias("level"), F.col("node").alias("target"), F.col("node_id").alias("target_id"))
    return flows.join(a, ["level", "source"]).join(b, ["level", "target"]).select(
        "level", "source", "target", "value", "source_id", "target_id"
    )


def regions(obs: DataFrame) -> DataFrame:
    """Distinct counties, cities and categories as (kind, value)."""
    kinds = {"county": "county", "city": "city", "category": "dataset_category"}
    combos = obs.select(*kinds.values()).distinct()
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()])
    return combos.select(F.inline(pairs)).where("value IS NOT NULL AND value <> ''").distinct()


def probability(df: DataFrame, c: str, value, new: str = "probability") -> DataFrame:
    """Share of the rows with ``c = value``, on every row."""
    hit = F.coalesce(F.col(c) == F.lit(value), F.lit(False))
    return attach(df, df.agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias(new)))


def bayes_row(df: DataFrame, a: str, va, b: str, vb) -> DataFrame:
    """One row: P(a), P(b), P(b|a) and P(a|b) = P(b|a)P(a)/P(b), NULL when nothing has b (formula ours)."""
    is_a = F.coalesce(F.col(a) == F.lit(va), F.lit(False))
    is_b = F.coalesce(F.col(b) == F.lit(vb), F.lit(False))
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_a).alias("na"), F.count_if(is_b).alias("nb"), F.count_if(is_a & is_b).alias("nab")
    )
    p_a, p_b = F.try_divide("na", "n"), F.try_divide("nb", "n")
    likelihood = F.try_divide("nab", "na")
    return counts.select(
        p_a.alias("p_a"),
        p_b.alias("p_b"),
        likelihood.alias("p_b_given_a"),
        F.try_divide(F.coalesce(likelihood, F.lit(0.0)) * p_a, p_b).alias("p_a_given_b"),
    )


def bayes(df: DataFrame, a: str, va, b: str, vb, new: str = "bayes") -> DataFrame:
    return attach(df, bayes_row(df, a, va, b, vb).select(F.col("p_a_given_b").alias(new)))


def regression_prediction(df: DataFrame, x: str, y: str, new: str = "prediction") -> DataFrame:
    """Fitted value of the straight line y ~ x on every row."""
    line = trend(df, x, y).select(F.col("slope").alias("__slope"), F.col("intercept").alias("__intercept"))
    fitted = F.col("__intercept") + F.col("__slope") * F.col(x)
    return attach(df, line).withColumn(new, fitted).drop("__slope", "__intercept")


def summary(df: DataFrame, columns: list[str], quantiles=(0.25, 0.5, 0.75)) -> DataFrame:
    """Long table of count, mean, std, min, quartiles and max per column (the data of a box plot)."""
    long = df.select(*[to_numeric(c).alias(c) for c in columns]).unpivot([], columns, "variable", "value")
    present = long.where("value IS NOT NULL")
    plain = present.groupBy("variable").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    cuts = exact_quantiles(present, "value", list(quantiles), by=["variable"])
    wide = cuts.groupBy("variable").agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"q{round(q * 100)}") for q in quantiles]
    )
    return plain.join(wide, "variable")


def missingness(df: DataFrame) -> DataFrame:
    """(column, null_count, null_share) for all columns in one pass; NaN and empty text count as missing."""
    kinds = dict(df.dtypes)

    def gone(c: str) -> Column:
        column = F.col(f"`{c}`")
        if kinds[c] in ("double", "float"):
            return column.isNull() | F.isnan(column)
        if kinds[c] == "string":
            return column.isNull() | (column == "")
        return column.isNull()

    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(gone(c)).alias(f"c_{i}") for i, c in enumerate(df.columns)])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"c_{i}").alias("null_count")) for i, c in enumerate(df.columns)]
    )
    return counts.select("n", F.inline(rows)).select(
        "column", "null_count", F.try_divide("null_count", "n").alias("null_share")
    )


def temporal_summary(df: DataFrame, time: str, grain: str = "month") -> DataFrame:
    """Rows, first and last time per period."""
    t = F.col(time)
    return (
        df.where(t.isNotNull())
        .groupBy(F.date_trunc(grain, t).alias("period"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.min(t).alias("first_time"), F.max(t).alias("last_time"))
    )


def spatial_summary(df: DataFrame, by=(), lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Bounding box, mean place, rows and share of rows without a place."""
    a, o = known(lat), known(lon)
    lost = F.when(a.isNull() | o.isNull(), 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(a).alias("south"),
        F.max(a).alias("north"),
        F.min(o).alias("west"),
        F.max(o).alias("east"),
        F.avg(a).alias("centre_lat"),
        F.avg(o).alias("centre_lon"),
        F.avg(lost).alias("null_share"),
    )


def interaction_grid(df: DataFrame, cell: float, x: str = "heat_x", y: str = "heat_y", z: str = "heat_z") -> DataFrame:
    """Heat map input: sum, mean and rows per square cell."""
    return (
        df.where(known(x).isNotNull() & known(y).isNotNull())
        .groupBy(F.floor(F.col(x) / cell).alias("cell_x"), F.floor(F.col(y) / cell).alias("cell_y"))
        .agg(F.sum(known(z)).alias("z_sum"), F.avg(known(z)).alias("z_mean"), F.count(F.lit(1)).alias("row_count"))
    )


def coverage_timeline(ranges: DataFrame) -> DataFrame:
    """Start, end and whole days per source."""
    return ranges.select("source_key", "time_start", "time_end", days_between("time_start", "time_end").alias("days"))
