"""Projection, derived columns and cleaning."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.ml.feature import VectorAssembler

from regionloom.functions import geo
from regionloom.functions.scalars import blank_to_null, epoch_seconds, title_label, to_numeric, to_time, to_year
from regionloom.operators.positions import ROW_ID, number_rows, row_test

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of a one-row table on every row, as one scalar subquery (evaluated once, no join)."""
    names = one_row.columns
    packed = one_row.select(F.struct(*names).alias("__one__"))
    joined = df.withColumn("__one__", packed.scalar())
    return joined.select(*df.columns, *[F.col(f"__one__.{n}").alias(n) for n in names])


# ---------------------------------------------------------------- projection


def subset(tables: dict[str, DataFrame], selections: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The listed columns of the listed tables; unknown tables and columns are passed over."""
    return {
        key: tables[key].select([c for c in columns if c in tables[key].columns])
        for key, columns in selections.items()
        if key in tables
    }


def name_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename where the old name exists and the new one does not; otherwise tag the column with the role."""
    taken = set(df.columns)
    renames = {old: new for old, new in mapping.items() if old in taken and new not in taken}
    roles = {old: new for old, new in mapping.items() if old not in renames and old in taken}
    tagged = [
        F.col(c).alias(c, metadata={**df.schema[c].metadata, "role": roles[c]}) if c in roles else F.col(c)
        for c in df.columns
    ]
    return df.select(tagged).withColumnsRenamed(renames)


def role_of(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get("role")


def exclude_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def remove_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column)


def type_cast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast; a value that does not fit becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def map_column(df: DataFrame, column: str, func, new: str | None = None) -> DataFrame:
    """A column through ``func``: a Column -> Column function, or a pandas UDF for anything else."""
    return df.withColumn(new or column, func(F.col(column)))


def map_rows(df: DataFrame, column: str, func, rows, order_by) -> DataFrame:
    """(__row_id__, value): a column through ``func`` for a selection of row positions (or ``"all"``)."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    numbered = number_rows(df.select(*dict.fromkeys([*order, column])), order)
    return numbered.where(row_test(rows)).select(ROW_ID, func(F.col(column)).alias("value"))


# ---------------------------------------------------------------- derived columns

_AGGREGATE_CALL = re.compile(r"\b(mean|avg|sum|min|max|count|std|stddev|median)\(\s*(?:(\w+)\[)?(\w+)\]?\s*\)", re.I)
_REFERENCE = re.compile(r"\b(\w+)\[(\w+)\]")
# Names of aggregates in expressions and the Spark aggregate of each.
_AGGREGATES = {
    "mean": F.avg,
    "avg": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": F.stddev_samp,
    "stddev": F.stddev_samp,
}


def derive(df: DataFrame, new: str, expression: str | Column) -> DataFrame:
    """Row expression (Spark SQL text or a Column). An unknown name is an analysis error."""
    return df.withColumn(new, F.expr(expression) if isinstance(expression, str) else expression)


def add_column(df: DataFrame, new: str, expression: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Computed column such as ``mean(fire[acres]) * 2.5`` or ``k[value] * 2``.

    Every aggregate call is computed over its whole table, once, and enters as a scalar subquery; the rest is an
    ordinary row expression on ``df``.
    """
    tables = tables or {}
    calls: list[tuple[str, str, str]] = []

    def note(match):
        calls.append((match.group(1).lower(), match.group(2) or "", match.group(3)))
        return f"`__agg_{len(calls) - 1}`"

    row_expression = _REFERENCE.sub(r"`\2`", _AGGREGATE_CALL.sub(note, expression))
    result = df
    by_table: dict[str, list[Column]] = {}
    for i, (function, key, column) in enumerate(calls):
        if function == "median":
            from regionloom.operators.quantiles import exact_quantiles

            median = exact_quantiles(tables.get(key, df), column, [0.5]).select(F.col("value").alias(f"__agg_{i}"))
            result = attach(result, median)
            continue
        by_table.setdefault(key, []).append(_AGGREGATES[function](column).alias(f"__agg_{i}"))
    for key, aggregates in by_table.items():
        result = attach(result, tables.get(key, df).agg(*aggregates))
    return result.withColumn(new, F.expr(row_expression)).drop(*[f"__agg_{i}" for i in range(len(calls))])


def set_if(df: DataFrame, condition: str | Column, column: str, value) -> DataFrame:
    """``value`` where the condition is true; an unknown condition counts as false."""
    test = F.expr(condition) if isinstance(condition, str) else condition
    value = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(column, F.when(test, value).otherwise(F.col(column)))


def population_ratios(df: DataFrame, population: DataFrame, distance: str = "distance_km", metric: str = "metric_value") -> DataFrame:
    """A one-row ``population`` on every row, per distance and per thousand people."""
    people = F.col("population")
    return attach(df, population.select("population")).withColumns(
        {
            "population_per_distance_km": people / F.greatest(F.col(distance), F.lit(0.1)),
            "metric_per_1000_people": F.coalesce(F.col(metric), F.lit(0.0)) / F.greatest(people / 1000.0, F.lit(1.0)),
        }
    )


# ---------------------------------------------------------------- cleaning


def first_present(df: DataFrame, candidates: list[str]) -> Column:
    """Row-wise first non-empty value among the candidate columns (names matched without case), as text."""
    known = {c.lower(): c for c in df.columns}
    found = list(dict.fromkeys(known[c.lower()] for c in candidates if c.lower() in known))
    tries = [blank_to_null(F.col(f"`{c}`")) for c in found]
    return F.coalesce(*tries) if tries else F.lit(None).cast("string")


# Column names under which each part of an observation is found, in this order.
OBSERVATION_CANDIDATES = {
    "year": ["year", "fireyear", "YEAR_", "incident_year"],
    "county": ["county", "COUNTY", "county_name"],
    "city": ["city", "CITY"],
    "latitude": ["latitude", "lat", "lat_dd", "y", "POINT_Y"],
    "longitude": ["longitude", "lon", "long_dd", "lng", "x", "POINT_X"],
    "metric_value": ["metric_value", "value", "esttotalacres", "protected_acres", "AREA_ft2", "ANNUAL_COS", "REPAIR_COS"],
}


def normalize_observations(
    df: DataFrame,
    source_key: str,
    centre: tuple[float, float],
    labels: dict[str, str] | None = None,
    impute: bool = False,
    order_by=None,
    # fixed values: the study region that imputed rows fall in
    default_county: str = "Klamath",
    default_city: str = "Klamath Falls",
    default_state: str = "OR",
) -> DataFrame:
    """The canonical observation columns, followed by the other columns of ``df``.

    Missing parts stay NULL. With ``impute`` they are filled in as a demonstration data set needs it: year 2020
    plus the row position, a place near the centre by position modulo 5, metric 1.0, default county and city;
    this needs a unique ``order_by``.
    """
    pick = {part: first_present(df, names) for part, names in OBSERVATION_CANDIDATES.items()}
    if impute:
        df = number_rows(df, order_by)
    lat, lon = to_numeric(pick["latitude"]), to_numeric(pick["longitude"])
    year, county, city = to_year(pick["year"]), pick["county"], pick["city"]
    metric = to_numeric(pick["metric_value"])
    if impute:
        shift = (F.col(ROW_ID) % 5) * 0.005
        placed = lat.isNotNull() & lon.isNotNull()
        lat, lon = (
            F.when(placed, lat).otherwise(F.lit(centre[0]) + shift),
            F.when(placed, lon).otherwise(F.lit(centre[1]) - shift),
        )
        year = F.coalesce(year, (F.lit(2020) + F.col(ROW_ID)).try_cast("int"))
        metric = F.coalesce(metric, F.lit(1.0))
        county, city = F.coalesce(county, F.lit(default_county)), F.coalesce(city, F.lit(default_city))
    label = title_label(F.lit(source_key), labels)
    core = {
        "session_source_key": F.lit(source_key),
        "source_label": label,
        "year": year,
        "county": county,
        "city": city,
        "state": F.lit(default_state),
        "latitude": lat,
        "longitude": lon,
        "metric_name": F.lit(source_key),
        "metric_value": metric,
    }
    taken = {c.lower() for c in core} | {
        "distance_km", "source", "target", "value", "heat_x", "heat_y", "heat_z", ROW_ID.lower(),
    }
    passed = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    base = df.select(*[c.alias(n) for n, c in core.items()], *passed)
    return base.withColumns(
        {
            "distance_km": geo.haversine("latitude", "longitude", *centre),
            "source": F.col("source_label"),
            "target": F.col("year").cast("string"),
            "value": F.col("metric_value"),
            "heat_x": F.col("longitude"),
            "heat_y": F.col("latitude"),
            "heat_z": F.col("metric_value"),
        }
    )


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where every listed column has a value (NaN counts as missing)."""
    kinds = dict(df.dtypes)
    tests = [
        F.col(c).isNotNull() & ~F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNotNull() for c in columns
    ]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def feature_columns(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """A double expression per usable column: its numbers, or epoch seconds for a column of dates.

    One aggregate over the table decides for all text columns at once; columns without any value are left out.
    """
    kinds = dict(df.dtypes)
    columns = [c for c in columns if c in kinds]
    choices: dict[str, tuple[Column, Column]] = {}
    for c in columns:
        if kinds[c] in ("timestamp", "date", "timestamp_ntz"):
            as_seconds = epoch_seconds(F.col(c).cast("timestamp")).cast("double")
            choices[c] = (as_seconds, as_seconds)
        elif kinds[c] == "string":
            choices[c] = (to_numeric(c), epoch_seconds(to_time(c)).cast("double"))
        else:
            choices[c] = (to_numeric(c), to_numeric(c))
    if not choices:
        return {}
    counts = df.agg(
        *[F.count(n).alias(f"n_{i}") for i, (n, _) in enumerate(choices.values())],
        *[F.count(d).alias(f"d_{i}") for i, (_, d) in enumerate(choices.values())],
    ).first()
    usable = {}
    for i, (c, (number, date)) in enumerate(choices.items()):
        if counts[f"n_{i}"]:
            usable[c] = number
        elif counts[f"d_{i}"]:
            usable[c] = date
    return usable


def feature_matrix(df: DataFrame, columns: list[str], output: str = "features", keep=()) -> DataFrame:
    """The usable columns as doubles and as one vector, complete rows only."""
    usable = feature_columns(df, columns)
    kept = [F.col(c) for c in keep if c not in usable]
    numbers = complete_cases(df.select(*kept, *[e.alias(c) for c, e in usable.items()]), list(usable))
    return VectorAssembler(inputCols=list(usable), outputCol=output).transform(numbers)


def drop_constant(df: DataFrame, columns: list[str], tolerance: float = 1e-10, least: int = 5) -> DataFrame:
    """Without the listed columns that have fewer than ``least`` numbers or (nearly) no spread."""
    row = df.agg(
        *[F.stddev_samp(to_numeric(c)).alias(f"s_{i}") for i, c in enumerate(columns)],
        *[F.count(to_numeric(c)).alias(f"n_{i}") for i, c in enumerate(columns)],
    ).first()
    gone = [c for i, c in enumerate(columns) if row[f"n_{i}"] < least or not (row[f"s_{i}"] or 0.0) > tolerance]
    return df.drop(*gone)


def normalize(df: DataFrame, columns: list[str], method: str = "zscore") -> DataFrame:
    """Scaled columns: z-score with the population deviation, or min-max. A constant column becomes 0."""
    stats = []
    for c in columns:
        if method == "zscore":
            stats += [F.avg(c).alias(f"__at_{c}"), F.stddev_pop(c).alias(f"__by_{c}")]
        else:
            stats += [F.min(c).alias(f"__at_{c}"), (F.max(c) - F.min(c)).alias(f"__by_{c}")]
    wide = attach(df, df.agg(*stats))
    scaled = {
        c: F.when(F.col(f"__by_{c}") > 0, (F.col(c) - F.col(f"__at_{c}")) / F.col(f"__by_{c}")).when(
            F.col(c).isNotNull(), F.lit(0.0)
        )
        for c in columns
    }
    return wide.withColumns(scaled).select(df.columns)


def split(df: DataFrame, by: str, values: list) -> dict:
    """A lazy table per given value (``None`` for the rows without one). For all values use ``split_write``."""
    return {v: df.where(F.col(by).eqNullSafe(F.lit(v))) for v in values}


def run_commands(df: DataFrame, commands: list[dict], preview: int | None = None) -> DataFrame:
    """An ordered list of commands, each ``{"type": name, ...arguments}``; nothing runs before an action."""
    from regionloom.operators import filters

    known = {
        "exclude_columns": exclude_columns,
        "derive": derive,
        "filter": filters.where,
        "remove_where": filters.remove_where,
        "type_cast": type_cast,
        "rename": name_columns,
        "normalize": normalize,
        "near": filters.near,
        "limit": lambda d, n: d.limit(n),
    }
    result = df
    for command in commands:
        arguments = {k: v for k, v in command.items() if k != "type"}
        result = result.transform(known[command["type"]], **arguments)
    return result if preview is None else result.limit(preview)
