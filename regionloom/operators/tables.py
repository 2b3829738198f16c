"""Set operations, sorts, limits and samples over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def fuse(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables under one another: the union of their columns plus ``__source__``. A column with differing
    types becomes text."""
    kinds: dict[str, set[str]] = {}
    for table in tables.values():
        for column, kind in table.dtypes:
            kinds.setdefault(column, set()).add(kind)
    clash = {c for c, k in kinds.items() if len(k) > 1}
    parts = []
    for key, table in tables.items():
        columns = [F.col(f"`{c}`").cast("string").alias(c) if c in clash else F.col(f"`{c}`") for c in table.columns]
        parts.append(table.select(*columns, F.lit(key).alias("__source__")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def concat(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def add_rows(df: DataFrame, rows: list) -> DataFrame:
    """Literal rows at the end."""
    return df.union(df.sparkSession.createDataFrame(rows, df.schema))


def distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def sort(df: DataFrame, columns: list[str], descending: bool = False) -> DataFrame:
    return df.orderBy(*[F.desc(c) if descending else F.asc(c) for c in columns])


def head(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def bar_data(df: DataFrame, x: str, y: str, order_by: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` pairs as chart input."""
    missing = [c for c in (x, y) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.orderBy(*order_by).limit(n).select(F.col(x).alias("x"), F.col(y).alias("y"))


def top_k(df: DataFrame, order, k: int, by=()) -> DataFrame:
    """The ``k`` first rows, or the ``k`` first of each key. Spark keeps only k rows per key and task before
    it shuffles, so a key that holds most rows does not gather them."""
    order = list(order) if isinstance(order, (list, tuple)) else [order]
    if not by:
        return df.orderBy(*order).limit(k)
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rank__", F.row_number().over(window)).where(F.col("__rank__") <= k).drop("__rank__")


def hash_order(row_id: str, seed: int = 42):
    """A fixed pseudo-random order over row ids."""
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")))


def deterministic_sample(df: DataFrame, n: int, row_id: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same on every run and every partitioning."""
    return df.orderBy(hash_order(row_id, seed), row_id).limit(n)


def sample_fraction(df: DataFrame, fraction: float, row_id: str, seed: int = 42) -> DataFrame:
    """The rows whose hashed id lies below ``fraction`` of all hashes: the same on every run, without any shuffle. Use it
    instead of :func:`deterministic_sample` where the sample is too large for one task."""
    share = F.conv(F.substring(hash_order(row_id, seed), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return df.where(share < fraction)


def limit_per_source(df: DataFrame, n: int, row_id: str = "id", source: str = "source_key", seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each source, in hash order."""
    return top_k(df, [hash_order(row_id, seed), F.col(row_id)], n, by=[source])
