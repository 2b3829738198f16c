"""Row positions without a single-task window, and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from regionloom.session import stage

ROW_ID = "__row_id__"
_LOW_BITS = (1 << 33) - 1


def _sorted_table(df: DataFrame, order_by: list[str], by: list[str]) -> DataFrame:
    """``df`` range-partitioned in order, with its partition ``__p__`` and the place ``__i__`` inside it."""
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order_by]]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))
    return stage(ordered.select("*", F.spark_partition_id().alias("__p__"), place.alias("__i__")))


def number_rows(df: DataFrame, order_by, by=(), name: str = ROW_ID) -> DataFrame:
    """Add the position 0, 1, 2 ... of each row, over the table or within each key of ``by``.

    ``order_by`` must be unique (within the key). The rows are range-partitioned, so one key may spread over
    many tasks; only one count per (key, partition) is gathered to find where each partition starts.
    """
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    by = list(by)
    rows = _sorted_table(df, order_by, by)
    parts = rows.groupBy(*by, "__p__").agg(F.count(F.lit(1)).alias("__n__"), F.min("__i__").alias("__first__"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__p__").rowsBetween(Window.unboundedPreceding, -1)
    # staged: with its true size known, Spark broadcasts it where it is small instead of shuffling the rows
    starts = parts.select(
        *[F.col(c).alias(f"__key_{c}") for c in by],
        F.col("__p__").alias("__q__"),
        (F.coalesce(F.sum("__n__").over(earlier), F.lit(0)) - F.col("__first__")).alias("__shift__"),
    )
    starts = stage(starts)
    match = F.col("__p__") == F.col("__q__")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    joined = rows.join(starts, match)
    return joined.select(*df.columns, (F.col("__i__") + F.col("__shift__")).cast("bigint").alias(name))


def parse_rows(spec):
    """``"a..b"`` (half open), ``"3"``, ``"1,4,7"``, a slice, a list or ``"all"`` -> ('range', a, b) or ('list', [...])."""
    if spec in (None, "all", ":"):
        return ("range", 0, None)
    if isinstance(spec, slice):
        return ("range", spec.start or 0, spec.stop)
    if isinstance(spec, int):
        return ("list", [spec])
    if isinstance(spec, (list, tuple)):
        return ("list", [int(x) for x in spec])
    if ".." in spec:
        low, high = spec.split("..", 1)
        return ("range", int(low or 0), int(high) if high.strip() else None)
    return ("list", [int(x) for x in spec.split(",")])


def row_test(spec, name: str = ROW_ID) -> Column:
    kind, *bounds = parse_rows(spec)
    if kind == "list":
        return F.col(name).isin(bounds[0])
    test = F.col(name) >= bounds[0]
    return test if bounds[1] is None else test & (F.col(name) < bounds[1])


def index(df: DataFrame, rows, columns, order_by) -> DataFrame:
    """Rows by position and columns by name, renumbered from 0. No known column in the list keeps them all."""
    if isinstance(columns, str):
        columns = df.columns if columns in ("all", ":") else [c.strip() for c in columns.split(",")]
    kept = [c for c in columns if c in df.columns] or df.columns
    kind, *bounds = parse_rows(rows)
    wanted = number_rows(df, order_by).where(row_test(rows))
    if kind == "range":
        place = F.col(ROW_ID) - F.lit(bounds[0])
        return wanted.select(place.cast("bigint").alias(ROW_ID), *kept)
    # the list is as long as the caller wrote it
    order = {p: i for i, p in enumerate(dict.fromkeys(bounds[0]))}
    lookup = F.create_map(*[F.lit(x).cast("bigint") for kv in order.items() for x in kv])
    return wanted.select(F.element_at(lookup, F.col(ROW_ID)).alias(ROW_ID), *kept)


def remove_rows(df: DataFrame, rows, order_by) -> DataFrame:
    """Drop a range or list of positions."""
    return number_rows(df, order_by).where(~row_test(rows)).drop(ROW_ID)


def align_by_position(left: DataFrame, right: DataFrame, left_order, right_order, pad: bool = False) -> DataFrame:
    """Pair the rows of two tables by position; cut to the shorter, or keep all of ``left`` with ``pad``."""
    a = number_rows(left, left_order)
    b = number_rows(right, right_order)
    return a.join(b, ROW_ID, "left" if pad else "inner")


def append_column(df: DataFrame, values: DataFrame, column: str, new: str, order_by, values_order) -> DataFrame:
    """Attach a column of another table by position: truncated when longer, NULL where shorter."""
    source = number_rows(values.select(*dict.fromkeys([*_as_list(values_order), column])), values_order)
    target = number_rows(df, order_by)
    picked = source.select(ROW_ID, F.col(column).alias(new))
    return target.drop(new).join(picked, ROW_ID, "left")


def _as_list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)
