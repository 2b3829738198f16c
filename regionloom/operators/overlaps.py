"""Pairs of intervals or boxes that meet, by equi joins over tiles.

Every box is filed at the level whose tiles are as wide as its longest side (powers of two), where it takes two tiles a way at
most. The finer of two boxes looks for the coarser one in the tiles that it takes itself at that one's level. A pair may meet
in several tiles; the one that holds the lower corner of the common part keeps it. No box is compared with all others, and
the copies of a box are bounded by the levels in use.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from regionloom.operators.positions import number_rows
from regionloom.session import stage

#: Rows of a block of ids, where these make fewer than ``MOST_BLOCKS`` blocks.
BLOCK_ROWS, MOST_BLOCKS = 8192, 1024
#: Finest level: sides below 2 ** -30 count as this long.
FINEST = -30


def _level(boxes: DataFrame, axes: int) -> Column:
    side = F.greatest(*[F.col(f"high{i}") - F.col(f"low{i}") for i in range(axes)], F.lit(0.0)) if axes > 1 else F.col("high0") - F.col("low0")
    return F.greatest(F.ceil(F.log2(F.greatest(side, F.lit(2.0**FINEST)))), F.lit(FINEST)).cast("int")


def _tiles(axis: int, level: Column) -> Column:
    width = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(F.col(f"low{axis}") / width).cast("long"), F.floor(F.col(f"high{axis}") / width).cast("long"))


def meeting_pairs(df: DataFrame, by: str, bounds: list[tuple[Column, Column]]) -> DataFrame:
    """(``a``, ``b``) of each two rows whose boxes meet, borders included, with a < b and each pair once.

    ``by`` is unique; ``bounds`` has the low and high end for each axis. A row with a NULL or NaN end, or with a high end
    below its low one, meets none.
    """
    ends = [c.cast("double").alias(f"{side}{i}") for i, pair in enumerate(bounds) for side, c in zip(("low", "high"), pair, strict=True)]
    boxes = df.select(F.col(by).alias("id"), *ends).where(F.col("id").isNotNull())
    for i in range(len(bounds)):
        boxes = boxes.where((F.col(f"low{i}") <= F.col(f"high{i}")) & ~F.isnan(f"high{i}"))
    axes = len(bounds)
    boxes = boxes.withColumn("level", _level(boxes, axes))
    levels = sorted(r["level"] for r in boxes.select("level").distinct().collect())  # as many as powers of two

    def filed(rows: DataFrame, at: Column) -> DataFrame:
        for i in range(axes):
            rows = rows.withColumn(f"tile{i}", F.explode(_tiles(i, at)))
        return rows

    coarse = filed(boxes, F.col("level"))
    coarse = coarse.select(*[F.col(c).alias(f"o_{c}") for c in ("id", "level", *[f"low{i}" for i in range(axes)], *[f"high{i}" for i in range(axes)])], *[F.col(f"tile{i}").alias(f"o_tile{i}") for i in range(axes)])
    wider = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col("level")) if levels else F.array().cast("array<int>")
    fine = filed(boxes.withColumn("at", F.explode(wider)), F.col("at"))
    same = F.col("at") == F.col("o_level")
    for i in range(axes):
        same = same & (F.col(f"tile{i}") == F.col(f"o_tile{i}"))
    met = fine.join(coarse, same).where((F.col("level") < F.col("o_level")) | (F.col("id") < F.col("o_id")))
    for i in range(axes):
        low = F.greatest(f"low{i}", f"o_low{i}")
        met = met.where((low <= F.col(f"high{i}")) & (low <= F.col(f"o_high{i}")) & (F.floor(low / F.pow(F.lit(2.0), "at")) == F.col(f"tile{i}")))
    return met.where(F.col("id") != F.col("o_id")).select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"))


def _behind(query_place: np.ndarray, query_time: np.ndarray, times: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each query the sums of ``weights`` over the rows from its place on whose time is not after its own.

    The rows from a place on are at most one aligned run of each power of two, and every run is searched in its order of time.
    """
    n, found = len(times), np.zeros((len(query_place), weights.shape[1]), np.int64)
    if not n or not len(query_place):
        return found
    order = np.argsort(times, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    upto = np.searchsorted(times[order], query_time, "right")
    levels = max(1, int(n - 1).bit_length())
    place = query_place.astype(np.int64)
    whole = place == 0
    for level in range(levels + 1):
        asked = np.flatnonzero(whole if level == levels else ((place >> level) & 1 == 1) & (place < n))
        if not len(asked):
            continue
        key = (np.arange(n) >> level) * (n + 1) + rank
        sequence = np.argsort(key)
        sums = np.concatenate([np.zeros((1, weights.shape[1]), np.int64), np.cumsum(weights[sequence], axis=0)])
        run = place[asked] >> level
        last = np.searchsorted(key[sequence], run * (n + 1) + upto[asked])
        found[asked] += sums[last] - sums[np.minimum(run << level, n)]
        place[asked] += 1 << level
    return found


_DAY = 86_400_000_000
_PARTS = ("n0", "s0", "n1", "s1")  # starts (0) and ends (1) that are not after a time: how many, and the sum of their days


def later_totals(df: DataFrame, by: str, low: Column, high: Column) -> DataFrame:
    """(``by``, ``n_later``, ``days``): how many rows of a larger ``by`` each interval meets, and the whole days that they share.

    ``low`` and ``high`` are microseconds, and all of them lie at the same time of the day. No pair becomes a row. The rows that
    meet an interval are those that start by its end less those that ended before its start; a common part ends at the other
    row's end where that lies in the interval, else at its own, and starts likewise. So four kinds of sums over the rows of
    larger ids and earlier times are enough. A grid of blocks of ids by spans of time holds them for whole blocks and spans;
    what is left is the row's own block, and the span of its time within later blocks. Both are groups of bounded size, since
    a span counts equal times of a block once.
    """
    rows = df.select(F.col(by).alias("k"), low.alias("t0"), high.alias("t1")).where("k IS NOT NULL AND t0 <= t1")
    rows = number_rows(rows, "k", name="place")
    rows = stage(rows)
    n = rows.count()
    size = max(BLOCK_ROWS, -(-n // MOST_BLOCKS))
    blocks = max(1, -(-n // size))
    rows = rows.withColumn("block", F.floor(F.col("place") / size).cast("int"))
    ends = rows.select("block", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"t{i}").alias("t")) for i in (0, 1)])).alias("e"))
    points = stage(ends.groupBy("e.t", "block").agg(*[F.count_if(F.col("e.kind") == i).alias(f"n{i}") for i in (0, 1)]))
    shares = [float(v) for v in np.linspace(0, 1, blocks + 1)[1:-1]]
    cuts = points.agg(F.percentile_approx("t", shares, 10 * MOST_BLOCKS).alias("cuts")).first()["cuts"] if shares else []
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def span(t: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, t.to_numpy(), "left").astype(np.int32))

    day = F.floor(F.col("t") / F.lit(_DAY)).cast("long")
    points = points.withColumns({"span": span("t"), "s0": F.col("n0") * day, "s1": F.col("n1") * day})
    cells = points.groupBy("block", "span").agg(*[F.sum(c).alias(c) for c in _PARTS]).toPandas()  # blocks x spans at most
    grid = np.zeros((blocks + 1, len(cuts) + 2, 4), np.int64)
    grid[cells["block"], cells["span"] + 1] = cells[list(_PARTS)].to_numpy(np.int64)
    # of later blocks and earlier spans
    grid = grid[::-1].cumsum(axis=0)[::-1].cumsum(axis=1)

    asked = rows.select("block", F.explode(F.array(F.col("t1"), F.col("t0") - 1)).alias("t")).distinct()
    asked = asked.withColumns({"span": span("t"), **{c: F.lit(0).cast("long") for c in _PARTS}, "asks": F.lit(True)})
    mates = points.select("block", "t", "span", *_PARTS, F.lit(False).alias("asks")).unionByName(asked)

    def of_span(part: pd.DataFrame) -> pd.DataFrame:
        data = part[~part["asks"]].sort_values("block", kind="stable")
        asks = part[part["asks"]]
        block, t = asks["block"].to_numpy(), asks["t"].to_numpy()
        place = np.searchsorted(data["block"].to_numpy(), block, "right")
        found = _behind(place, t, data["t"].to_numpy(), data[list(_PARTS)].to_numpy(np.int64))
        found += grid[block + 1, asks["span"].to_numpy()]
        return pd.DataFrame({"block": block, "t": t, **dict(zip(_PARTS, found.T))})

    def of_block(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        place, out = np.arange(len(part)) + 1, {c: part[c].to_numpy() for c in ("k", "block", "t0", "t1")}
        for name, t in (("till", out["t1"]), ("before", out["t0"] - 1)):
            for i in (0, 1):
                times = out[f"t{i}"]
                found = _behind(place, t, times, np.column_stack([np.ones(len(times), np.int64), times // _DAY]))
                out[f"{name}_n{i}"], out[f"{name}_s{i}"] = found.T
        return pd.DataFrame(out)

    far = stage(mates.groupBy("span").applyInPandas(of_span, "block int, t long, " + ", ".join(f"{c} long" for c in _PARTS)))
    own = [f"{name}_{c}" for name in ("till", "before") for c in _PARTS]
    near = rows.groupBy("block").applyInPandas(of_block, f"k {rows.schema['k'].dataType.simpleString()}, block int, t0 long, t1 long, " + ", ".join(f"{c} long" for c in own))
    for name, t in (("till", F.col("t1")), ("before", F.col("t0") - 1)):
        near = near.withColumn("t", t).join(far, ["block", "t"])
        near = near.withColumns({f"{name}_{c}": F.col(f"{name}_{c}") + F.col(c) for c in _PARTS}).drop("t", *_PARTS)
    met = F.col("till_n0") - F.col("before_n1")
    begin, end = F.floor(F.col("t0") / F.lit(_DAY)), F.floor(F.col("t1") / F.lit(_DAY))
    inner = {i: F.col(f"till_n{i}") - F.col(f"before_n{i}") for i in (0, 1)}
    last = F.col("till_s1") - F.col("before_s1") + (met - inner[1]) * end
    first = F.col("till_s0") - F.col("before_s0") + (met - inner[0]) * begin
    return near.select(F.col("k").alias(by), met.alias("n_later"), (last - first).cast("long").alias("days")).where("n_later > 0")
