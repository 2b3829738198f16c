"""Exact quantiles of any group size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from regionloom.operators.positions import _sorted_table
from regionloom.session import stage


def exact_quantiles(df: DataFrame, value: str, quantiles: list[float], by=()) -> DataFrame:
    """(by..., q, value) with linear interpolation between neighbours.

    NULL and NaN are no values. Equal values are counted before the shuffle; the distinct values are range-partitioned, so that one hot group
    spreads over many tasks. Running counts are taken per (group, partition) and shifted by the totals of the
    partitions before; no task holds a whole group.
    """
    by = list(by)
    counted = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__w__"))
    rows = _sorted_table(counted, [value], by)
    parts = rows.groupBy(*by, "__p__").agg(F.sum("__w__").alias("__n__"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy("__p__").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumns(
        {"__before__": F.coalesce(F.sum("__n__").over(earlier), F.lit(0)), "__total__": F.sum("__n__").over(group)}
    )
    ranks = F.array(
        *[
            F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("__total__") - 1)).alias("h"))
            for q in quantiles
        ]
    )
    wanted = starts.select("*", F.inline(ranks)).where(
        (F.floor("h") < F.col("__before__") + F.col("__n__")) & (F.ceil("h") >= F.col("__before__"))
    )
    wanted = stage(wanted.select(*by, "__p__", "__before__", "q", "h"))
    # only partitions that hold a wanted rank go on
    here = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "__p__"]]
    test = here[0]
    for t in here[1:]:
        test = test & t
    running = Window.partitionBy(*by, "__p__").orderBy("__i__").rowsBetween(Window.unboundedPreceding, 0)
    touched = rows.alias("r").join(wanted.select(*by, "__p__").distinct().alias("s"), test, "left_semi")
    placed = touched.withColumn("__upto__", F.sum("__w__").over(running)).alias("r")
    last = F.col("__before__") + F.col("__upto__") - 1
    first = F.col("__before__") + F.col("__upto__") - F.col("__w__")
    hits = placed.join(wanted.alias("s"), test).where(
        F.floor("h").between(first, last) | F.ceil("h").between(first, last)
    )
    low = F.max(F.when(F.floor("h").between(first, last), F.col(f"r.{value}")))
    high = F.max(F.when(F.ceil("h").between(first, last), F.col(f"r.{value}")))
    share = F.max(F.col("h") - F.floor("h"))
    return hits.groupBy(*[F.col(f"r.{c}").alias(c) for c in by], "q").agg(
        (low + (high - low) * share).alias("value")
    )
