"""Equal-width, right-closed frequency bins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from regionloom.functions.scalars import to_numeric
from regionloom.session import spread, stage


def _edge_digits(x: Column) -> Column:
    """Edges are shown with three digits: after the point, or after the leading zeros of a fraction."""
    size = F.abs(x)
    whole = F.round(x, 3)
    digits = F.ceil(-F.log10(F.when(size > 0, size))) + 2
    scale = F.pow(F.lit(10.0), digits)
    return F.when((size >= 1) | (size == 0), whole).otherwise(F.round(x * scale, 0) / scale)


def _edges(low: Column, high: Column, bins: Column) -> Column:
    """All edges of a group: a constant column gets 0.1 % on either side, any other has its first edge
    lowered by 0.1 % of the range, so that the smallest value falls inside."""
    pad_low = F.when(low != 0, F.abs(low) * 0.001).otherwise(0.001)
    pad_high = F.when(high != 0, F.abs(high) * 0.001).otherwise(0.001)
    flat = low == high
    start = F.when(flat, low - pad_low).otherwise(low)
    end = F.when(flat, high + pad_high).otherwise(high)
    step = (end - start) / bins

    def edge(i):
        inner = F.when(i == bins, end).otherwise(start + i * step)
        return F.when((i == 0) & ~flat, start - (end - start) * 0.001).otherwise(inner)

    return F.transform(F.sequence(F.lit(0), bins), edge)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _labels(edges: pd.Series) -> pd.Series:
    """``low to high`` per bin with two digits of the binary value (Java's formatter rounds the printed decimal
    instead). Runs on one row per group, never on data rows."""
    return pd.Series([[f"{a:.2f} to {b:.2f}" for a, b in zip(e[:-1], e[1:])] for e in edges], dtype=object)


def bin_edges(long: DataFrame, bins: int, by: list[str]) -> DataFrame:
    """Per group: the edges as used and as shown, and min(bins, distinct values) bins with their labels."""
    # A sketch of at most n values never reports noticeably more than n, so a report well above ``bins`` settles that
    # there are enough values. Only the groups below it are counted exactly, and those have few values to shuffle.
    stats = stage(
        long.groupBy(*by).agg(
            F.min("value").alias("__low"), F.max("value").alias("__high"), F.approx_count_distinct("value").alias("__about")
        )
    )
    few = stats.where(F.col("__about") <= 2 * bins + 8).select(*by)
    counted = stats.withColumn("__d", F.lit(bins))
    if not few.isEmpty():
        values = long.join(few, by, "left_semi").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("__w"))
        exact = values.groupBy(*by).agg(F.count(F.lit(1)).alias("__d"))
        counted = stats.join(exact, by, "left").withColumn("__d", F.coalesce(F.col("__d"), F.lit(bins)))
    count = F.least(F.lit(bins), F.col("__d").cast("int"))
    edged = counted.select(*by, count.alias("__bins"), _edges(F.col("__low"), F.col("__high"), count).alias("__edges"))
    shown = edged.withColumn("__shown", F.transform("__edges", _edge_digits))
    # staged: used more than once, and its true size lets Spark broadcast it to the rows
    return stage(shown.withColumn("__labels", _labels("__shown")))


def with_bin(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the number (0 based) of the right-closed bin: the equal width gives it to within one, the edges decide.

    In steps, so that each expression is planned once instead of being repeated inside the next.
    """
    edges, bins = F.col("__edges"), F.col("__bins")
    first, last = F.get(edges, F.lit(0)), F.get(edges, bins)
    x, g = F.col("__x"), F.col("__g")
    df = df.withColumn("__x", value)
    df = df.withColumn("__g", F.floor((x - first) / ((last - first) / bins)).cast("int"))
    df = df.withColumn("__g", F.when(g < 0, 0).when(g >= bins, bins - 1).otherwise(g))
    lower = F.when((g > 0) & (x <= F.get(edges, g)), -1).otherwise(0)
    higher = F.when((g < bins - 1) & (x > F.get(edges, g + 1)), 1).otherwise(0)
    return df.withColumn(name, g + lower + higher).drop("__x", "__g")


def long_values(df: DataFrame, variables: list[str], by: list[str]) -> DataFrame:
    present = [v for v in variables if v in df.columns]
    wide = spread(df.select(*by, *[to_numeric(v).alias(v) for v in present]))
    return wide.unpivot(by, present, "variable", "value").where("value IS NOT NULL")


def frequency_bins(df: DataFrame, variables: list[str], bins: int = 5, by: str = "source_key") -> DataFrame:
    """One row per source, variable and bin, empty bins included: label, low, high, midpoint and count."""
    keys = [by, "variable"]
    long = long_values(df, variables, [by])
    edges = bin_edges(long, bins, keys)
    counted = with_bin(long.join(edges, keys), F.col("value"), "bin").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("__n"))
    # one row per bin; staged, so that the outer join below does not push its conditions into the row expressions
    counts = stage(counted)
    all_bins = edges.select(*keys, "__shown", "__labels", F.explode(F.sequence(F.lit(0), F.col("__bins") - 1)).alias("bin"))
    framed = all_bins.select(
        *keys,
        "bin",
        F.get("__labels", F.col("bin")).alias("bin_label"),
        F.get("__shown", F.col("bin")).alias("bin_low"),
        F.get("__shown", F.col("bin") + 1).alias("bin_high"),
    )
    return framed.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        "bin_label",
        "bin_low",
        "bin_high",
        ((F.col("bin_low") + F.col("bin_high")) / 2).alias("bin_midpoint"),
        F.coalesce("__n", F.lit(0)).alias("count"),
    )


def distribution(df: DataFrame, variable: str, bins: int = 10) -> DataFrame:
    """Histogram of one column."""
    return frequency_bins(df.withColumn("__all", F.lit("all")), [variable], bins, by="__all").drop("__all", "variable")


def distribution_bin(df: DataFrame, variable: str, bins: int = 5, by: str = "source_key", new: str = "bin_label") -> DataFrame:
    """The label of its bin on every row (NULL without a value)."""
    edges = bin_edges(long_values(df, [variable], [by]), bins, [by, "variable"]).drop("variable")
    numbered = with_bin(df.join(edges, by, "left"), to_numeric(variable), "__bin")
    return numbered.withColumn(new, F.get("__labels", F.col("__bin"))).select(*df.columns, new)
