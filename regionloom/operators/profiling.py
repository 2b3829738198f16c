"""Column profiles: counts and a semantic type for every column, over the whole table."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from regionloom.functions.scalars import looks_numeric, unit_suffix
from regionloom.operators.columns import attach
from regionloom.session import spread

# Name patterns, tested in the order of ``_rules``.
GEO_NAME = r"(?i)(lat|lon|y_coord|x_coord)"
MONEY_NAME = r"(?i)(cost|earnings|suppression_cost)"
TIME_NAME = r"(?i)(^|_)(year|month|day|date|time|date_range)($|_)"
DIMENSION_NAME = r"(?i)(length|width|depth|height|slope|area|volume|radius)"
ID_NAME = r"(?i)(^|_)(id|uuid|irwin|fod_id|fid)($|_)"
# A column with fewer distinct values, and a smaller share of them, is a list of labels.
LABEL_SHARE = 0.1
LABEL_COUNT = 50


def _measures(field: T.StructField) -> dict[str, Column]:
    """What is counted of a column: its value where present (else NULL), and tests and numbers for the rules."""
    raw = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        present = raw.isNotNull() & ~F.isnan(raw)
    elif isinstance(kind, T.StringType):
        present = raw.isNotNull() & (raw != "")
    else:
        present = raw.isNotNull()
    value = F.when(present, raw.cast("string") if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else raw)
    money = like_number = F.lit(False)
    plain_number = F.lit(None).cast("double")
    if isinstance(kind, T.StringType):
        like_number = present & looks_numeric(raw)
        plain_number = F.when(like_number, raw.try_cast("double"))
        money = present & raw.startswith("$")
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        like_number = present
        if not isinstance(kind, T.BooleanType):
            # numbers whose usual text has an exponent do not look like plain digits
            size = F.abs(raw.cast("double"))
            plain_number = F.when(present & ((size == 0) | size.between(1e-4, 9.999999999999999e15)), raw.cast("double"))
    return {"value": value, "present": present, "like_number": like_number, "plain_number": plain_number, "money": money}


def _counted(measures: dict[str, Column], i: int) -> list[Column]:
    return [
        F.count_if(~measures["present"]).alias(f"null_{i}"),
        F.count_if(measures["like_number"]).alias(f"numeric_{i}"),
        F.min(measures["plain_number"]).cast("double").alias(f"low_{i}"),
        F.max(measures["plain_number"]).cast("double").alias(f"high_{i}"),
        F.count_if(measures["money"]).alias(f"money_{i}"),
    ]


_COUNTS = {"null_count": "null", "numeric": "numeric", "low": "low", "high": "high", "money": "money"}


def _by_column(wide: DataFrame, names: list[str], counts: dict[str, str]) -> DataFrame:
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), *[F.col(f"{c}_{i}").alias(alias) for alias, c in counts.items()])
        for i, name in enumerate(names)
    ]
    return wide.select("n", F.inline(F.array(*rows)))


#: Values of all columns that a task counts the distinct ones of.
TASK_VALUES = 1 << 19
_BY_ARROW = (T.NumericType, T.BooleanType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _distinct_counts(df: DataFrame, values: list[Column]) -> DataFrame:
    """One row: ``unique_i``, how many distinct values each column has.

    A value is a row of its column's place and itself, in the column of its type; each batch drops its own copies, so neither a
    frequent value nor a table of all values of a task is held. The number of tasks grows with the rows.
    """
    wide = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    fields = wide.schema.fields
    odd = [not isinstance(f.dataType, _BY_ARROW) for f in fields]
    wide = wide.select(
        *[F.col(f.name) + F.lit(0).cast(f.dataType) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name).cast("string") if o else F.col(f.name) for f, o in zip(fields, odd)]
    ).toDF(*[f.name for f in fields])
    kinds = list(dict.fromkeys(f.dataType for f in wide.schema.fields))
    at = [kinds.index(f.dataType) for f in wide.schema.fields]
    schema = T.StructType([T.StructField("position", T.IntegerType()), *[T.StructField(f"k{j}", kind) for j, kind in enumerate(kinds)]])

    def unlike(batches):
        for batch in batches:
            types = [batch.column(at.index(j)).type for j in range(len(kinds))]
            for i, j in enumerate(at):
                found = batch.column(i).drop_null().unique()
                if len(found):
                    columns = [found if other == j else pa.nulls(len(found), kind) for other, kind in enumerate(types)]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int32()), *columns], names=schema.names)

    tasks = max(1, math.ceil(df.count() * len(values) / TASK_VALUES))
    each = wide.mapInArrow(unlike, schema).repartition(tasks, *schema.names).distinct()
    counts = each.groupBy("position").agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(*[F.coalesce(F.max(F.when(F.col("position") == i, F.col("c"))), F.lit(0).cast("bigint")).alias(f"unique_{i}") for i in range(len(values))])


def _facts(df: DataFrame, exact: bool) -> DataFrame:
    """One row per column with the counts that the rules need: one aggregate over the table, and one for the exact
    distinct counts, whose rows carry one value each."""
    aggregates: list[Column] = [F.count(F.lit(1)).alias("n")]
    values: list[Column] = []
    for i, field in enumerate(df.schema.fields):
        measures = _measures(field)
        if exact:
            values.append(measures["value"])
        else:
            aggregates.append(F.approx_count_distinct(measures["value"]).alias(f"unique_{i}"))
        aggregates += _counted(measures, i)
    wide = df.agg(*aggregates)
    if values:
        wide = attach(wide, _distinct_counts(df, values))
    return _by_column(wide, df.columns, _COUNTS | {"unique_values": "unique"})


#: Bits of the sketches of distinct values, and the relative error that three of their standard errors make.
DISTINCT_BITS = 14
DISTINCT_ERROR = 3 * 1.04 / 2 ** (DISTINCT_BITS / 2)
#: Size of the sketches of quantiles; a rank is off by about this share of the numbers at most.
QUANTILE_SIZE = 400
QUANTILE_ERROR = 0.01


def profile_state(df: DataFrame) -> DataFrame:
    """One row per column from which a profile follows, and which adds up: counts and extremes, a sketch of the distinct
    values and one of the quantiles of the numbers. One pass over the table, of which nothing but the sketches travels.

    Write it beside the data it is of; ``merge_states`` puts the states of old and new data together.
    """
    aggregates: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, field in enumerate(df.schema.fields):
        measures = _measures(field)
        aggregates += _counted(measures, i)
        aggregates.append(F.hll_sketch_agg(measures["value"].cast("string"), DISTINCT_BITS).alias(f"distinct_{i}"))
        aggregates.append(F.kll_sketch_agg_double(measures["plain_number"], QUANTILE_SIZE).alias(f"quantiles_{i}"))
    return _by_column(df.agg(*aggregates), df.columns, _COUNTS | {"distinct": "distinct", "quantiles": "quantiles"})


def merge_states(states: list[DataFrame]) -> DataFrame:
    """The state of all the data that the states are of. Columns are matched by name, in the order of their first places."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy("name").agg(
        F.sum("n").alias("n"),
        F.min("position").alias("position"),
        *[F.sum(c).alias(c) for c in ("null_count", "numeric", "money")],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def profile_of_state(state: DataFrame) -> DataFrame:
    """The profile that a state stands for: as ``profile``, with the distinct counts off by ``DISTINCT_ERROR`` at most (nearly
    always), and the quartiles of the numbers (NULL without any), whose ranks are off by about ``QUANTILE_ERROR``."""
    kind, tag = _rules()
    known = F.coalesce(F.kll_sketch_get_n_double("quantiles") > 0, F.lit(False))
    quartiles = {f"q{int(100 * q)}": F.when(known, F.kll_sketch_get_quantile_double("quantiles", F.lit(q))) for q in (0.25, 0.5, 0.75)}
    estimated = state.withColumn("unique_values", F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0).cast("bigint")))
    return estimated.select(
        "position", "name", kind.alias("inferred_type"), tag.alias("inferred_unit_tag"), "n", "null_count", "unique_values", "low", "high",
        *[c.alias(name) for name, c in quartiles.items()],
    )


def _rules() -> tuple[Column, Column]:
    """Semantic type and unit tag; the first name rule that applies decides. A place name whose values are not
    degrees goes to the last, numeric test only."""
    name = F.col("name")
    geo = name.rlike(GEO_NAME)
    degrees = F.coalesce(F.col("low") >= -180, F.lit(False)) & F.coalesce(F.col("high") <= 180, F.lit(False))
    money = name.rlike(MONEY_NAME) | (F.col("money") > 0)
    suffix = unit_suffix("name")
    dimension = F.nullif(F.lower(F.regexp_extract(name, DIMENSION_NAME, 1)), F.lit(""))
    sized = suffix.isNotNull() | dimension.isNotNull()
    label = (F.try_divide("unique_values", "n") < LABEL_SHARE) & (F.col("unique_values") < LABEL_COUNT)
    filled = F.col("n") - F.col("null_count")
    all_numbers = (filled > 0) & (F.col("numeric") == filled)
    last = F.when(all_numbers, "numeric").otherwise("string")
    kind = (
        F.when(geo & degrees, "float")
        .when(geo, last)
        .when(money, "currency")
        .when(name.rlike(TIME_NAME), "datetime")
        .when(sized, "numeric")
        .when(name.rlike(ID_NAME), last)
        .when(label, "categorical")
        .otherwise(last)
    )
    tag = (
        F.when(geo & degrees, "decimal_degrees")
        .when(geo, F.lit(None))
        .when(money, "USD")
        .when(name.rlike(TIME_NAME), "temporal")
        .when(sized, F.coalesce(suffix, dimension))
        .when(name.rlike(ID_NAME), "unique_identifier")
        .when(label, "label_lookup")
    )
    return kind, tag


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """(name, inferred_type, inferred_unit_tag, null_count, unique_values) in column order.

    ``exact=False`` estimates the distinct counts, which saves the shuffle of all values on very wide or large tables.
    """
    kind, tag = _rules()
    return _facts(spread(df), exact).select(
        "name", kind.alias("inferred_type"), tag.alias("inferred_unit_tag"), "null_count", "unique_values"
    )


def find_matching_types(tables: dict[str, DataFrame], keys: list[str], types: list[str], exact: bool = True) -> DataFrame:
    """(source_key, name, inferred_type) of the columns whose type is in the set."""
    parts = [profile(tables[k], exact).withColumn("source_key", F.lit(k)) for k in keys if k in tables]
    if not parts:
        return SparkSession.active().createDataFrame([], "source_key string, name string, inferred_type string")
    found = reduce(DataFrame.unionByName, parts)
    return found.where(F.col("inferred_type").isin(list(types))).select("source_key", "name", "inferred_type")


# Base group of each semantic type.
BASE_GROUPS = {"float": "spatial", "datetime": "time", "numeric": "numeric", "currency": "numeric", "categorical": "categorical", "string": "categorical"}


def type_similarity(tables: dict[str, DataFrame], exact: bool = True) -> DataFrame:
    """Pairs of columns of different tables with the same base group and unit tag (choice ours).

    Works on the profiles: one row per column, never on data rows.
    """
    groups = F.create_map(*[F.lit(x) for kv in BASE_GROUPS.items() for x in kv])
    parts = [profile(t, exact).withColumn("source_key", F.lit(k)) for k, t in tables.items()]
    columns = reduce(DataFrame.unionByName, parts).select(
        "source_key", "name", F.element_at(groups, F.col("inferred_type")).alias("base"), F.coalesce("inferred_unit_tag", F.lit("")).alias("tag")
    )
    a = columns.select("base", "tag", F.col("source_key").alias("source_a"), F.col("name").alias("name_a"))
    b = columns.select("base", "tag", F.col("source_key").alias("source_b"), F.col("name").alias("name_b"))
    return a.join(b, ["base", "tag"]).where("source_a < source_b")
