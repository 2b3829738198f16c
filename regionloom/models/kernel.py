"""Support vector machines with an RBF kernel, solved in the dual by decomposition.

The rows stay in a table, each with its dual variable and its decision sum. Where the kernel is a short sum of products of
functions of one feature, all rows are solved in its terms (``expansion``). Else a cascade gives a start: parts of the rows are
solved side by side, their support vectors meet in pairs and are solved again, up to one node. Then every pass takes the rows
that violate the optimality conditions most, a bounded working set, solves their part of the dual exactly with all others
fixed, and adds the change of their variables to every row's decision sum. The dual only improves, and passes end when the
greatest violation over all rows is within the gap asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from regionloom.models import expansion
from regionloom.session import drop_stage, spread, stage

#: Rows of a working set, and of a node of the cascade (from each of its two children half of that).
WORKING_ROWS = 1024
#: Greatest violation at which the dual counts as solved.
GAP = 1e-3
#: Rows that meet a working set at once: their kernel values stay in a processor's cache.
_SLICE = 128


def kernel(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    """The exponents come from one product of the rows, lengthened by two columns."""
    left = np.column_stack([x, (x**2).sum(axis=1), np.ones(len(x))])
    right = np.column_stack([2 * gamma * z, np.full(len(z), -gamma), -gamma * (z**2).sum(axis=1)])
    k = left @ right.T
    return np.exp(np.minimum(k, 0, out=k), out=k)


def solved(k: np.ndarray, y: np.ndarray, alpha: np.ndarray, sums: np.ndarray, c: float, gap: float = GAP / 4) -> np.ndarray:
    """Dual variables of a working set; ``sums`` are its decision sums with ``alpha``, and pairs are changed until no pair
    violates the conditions by more than ``gap`` (pairs by the second-order rule of Fan, Chen and Lin 2005)."""
    alpha, score = alpha.copy(), y - sums  # of a row that may rise in its class; at the optimum none exceeds what may fall
    diagonal = np.diag(k)
    curve = np.maximum(diagonal[:, None] + diagonal - 2 * k, 1e-12)
    # 0 for a row that may rise (fall), else minus infinity; a step changes them for its two rows alone
    up = np.where(np.where(y > 0, alpha < c, alpha > 0), 0.0, -np.inf)
    low = np.where(np.where(y > 0, alpha > 0, alpha < c), 0.0, -np.inf)
    excess, gain = np.empty(len(y)), np.empty(len(y))
    for _ in range(100 * len(y) + 1000):
        np.add(score, up, out=excess)
        i = int(excess.argmax())
        if excess[i] == -np.inf:
            break
        np.subtract(excess[i], score, out=excess)
        excess += low
        if excess.max() <= gap:
            break
        np.maximum(excess, 0, out=gain)
        gain *= gain
        gain /= curve[i]
        j = int(gain.argmax())
        step = excess[j] / curve[i, j]
        step = min(step, c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
        alpha[i] = min(max(alpha[i] + y[i] * step, 0.0), c)
        alpha[j] = min(max(alpha[j] - y[j] * step, 0.0), c)
        for t in (i, j):
            grows, shrinks = alpha[t] < c, alpha[t] > 0
            up[t] = 0.0 if (grows if y[t] > 0 else shrinks) else -np.inf
            low[t] = 0.0 if (shrinks if y[t] > 0 else grows) else -np.inf
        np.subtract(k[i], k[j], out=gain)
        gain *= step
        score -= gain
    return alpha


@dataclass
class Machine:
    """A two-class machine: ``rows`` has ``id``, ``x``, ``y`` (1, -1; 0 for rows of other classes), ``alpha`` and ``sum``."""

    rows: DataFrame
    bias: float
    gap: float
    passes: int

    @property
    def decision(self) -> Column:
        return F.col("sum") + F.lit(self.bias)


def _x(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _cascade(rows: DataFrame, gamma: float, c: float, node: int) -> pd.DataFrame:
    """Support vectors (``id``, ``x``, ``y``, ``alpha``) of the last node; a node passes on half a node of them at most, those
    inside their bounds before those at the upper one."""
    schema = "part long, id long, x array<double>, y double, alpha double"
    half = node // 2

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", ignore_index=True)
        x, y = np.stack(part["x"].to_numpy()), part["y"].to_numpy()
        k = kernel(x, x, gamma)
        # variables of different children add up to a feasible start
        alpha = part["alpha"].to_numpy()
        alpha = solved(k, y, alpha, k @ (alpha * y), c)
        keep = np.flatnonzero(alpha > 1e-12)
        if len(keep) > half:
            keep = keep[np.lexsort((part["id"].to_numpy()[keep], alpha[keep] >= c * (1 - 1e-9)))][:half]
            # what is left has to balance: solve it by itself
            again = solved(k[np.ix_(keep, keep)], y[keep], np.zeros(len(keep)), np.zeros(len(keep)), c)
            alpha[keep] = again
        return part.iloc[keep].assign(alpha=alpha[keep], part=part["part"] // 2)[["part", "id", "x", "y", "alpha"]]

    two = rows.where("y <> 0")
    n = two.count()
    width = max(1, int(np.ceil(n / (node * 0.9))))  # full nodes from the first level on: their number is what costs
    level = two.select(F.pmod(F.xxhash64("id"), F.lit(width)).alias("part"), "id", "x", "y", F.lit(0.0).alias("alpha"))
    while True:
        level = stage(level.groupBy("part").applyInPandas(solve, schema))
        if width == 1:
            return level.toPandas()
        width = (width + 1) // 2


def _moved(gamma: float, x: np.ndarray, change: np.ndarray, alphas: dict[int, float]):
    """Add the change of some rows' variables (times their classes) to all decision sums, and note the variables."""

    def run(batches):
        for batch in batches:
            parts = []
            for at in range(0, batch.num_rows, _SLICE):
                parts.append(kernel(_x(batch.slice(at, _SLICE).column("x")), x, gamma) @ change)
            sums = batch.column("sum").to_numpy() + (np.concatenate(parts) if parts else np.zeros(0))
            alpha = batch.column("alpha").to_numpy().copy()
            ids = batch.column("id").to_numpy()
            for k in np.flatnonzero(np.isin(ids, np.fromiter(alphas, np.int64))):
                alpha[k] = alphas[ids[k]]
            kept = [batch.column(name) for name in ("id", "x", "y")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(alpha), pa.array(sums)], names=["id", "x", "y", "alpha", "sum"])

    return run


def _by_terms(rows: DataFrame, gamma: float, c: float, working: int, gap: float) -> DataFrame | None:
    """All rows solved in the terms of the kernel's expansion, if they are more than a working set and it is short."""
    two = rows.where("y <> 0")
    n = two.count()
    if n <= working:
        return None
    ends = rows.select(F.posexplode("x")).groupBy("pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).orderBy("pos").toPandas()
    e = expansion.expansion(ends["low"].to_numpy(), ends["high"].to_numpy(), gamma)
    found = expansion.solved(e, two, n, c, gap) if e else None
    return stage(rows.select("id", "x", "y").mapInArrow(expansion.decided(*found), _ROWS)) if found else None


_ROWS = "id long, x array<double>, y double, alpha double, sum double"


def machine(rows: DataFrame, gamma: float, c: float = 1.0, working: int = WORKING_ROWS, most_passes: int | None = None, gap: float = GAP) -> Machine:
    """Solve for ``rows`` (``id`` unique, ``x``, ``y``) until no violation is greater than ``gap``. Up to ``working`` rows are
    solved in one pass. Only if ``most_passes`` is given may passes of working sets end before; ``gap`` of the result tells
    how far they got."""
    table = rows.select("id", "x", F.col("y").cast("double").alias("y"), F.lit(0.0).alias("alpha"), F.lit(0.0).alias("sum"))
    table = stage(spread(table))
    whole = _by_terms(table, gamma, c, working, gap) if most_passes is None else None
    start = _cascade(table, gamma, c, working) if whole is None else ()

    def moved(table: DataFrame, x, y, before, after, ids) -> DataFrame:
        changed = np.flatnonzero(np.abs(after - before) > 0)
        change = (after - before)[changed] * y[changed]
        alphas = {int(ids[k]): float(after[k]) for k in changed}
        after_all = stage(table.mapInArrow(_moved(gamma, x[changed], change, alphas), _ROWS))
        drop_stage(table)  # passes would else leave a copy of all rows each
        return after_all

    if len(start):
        x, y, alpha = np.stack(start["x"].to_numpy()), start["y"].to_numpy(), start["alpha"].to_numpy()
        table = moved(table, x, y, np.zeros(len(y)), alpha, start["id"].to_numpy())
    if whole is not None:
        drop_stage(table)
        table = whole
    score = F.col("y") - F.col("sum")
    up = F.when(F.col("y") > 0, F.col("alpha") < c).otherwise(F.col("alpha") > 0)
    low = F.when(F.col("y") > 0, F.col("alpha") > 0).otherwise(F.col("alpha") < c)
    passes = 0
    while True:
        active = table.where("y <> 0").withColumn("score", score)
        rising = active.where(up).orderBy(F.desc("score"), "id").limit(working // 2)
        falling = active.where(low).orderBy(F.asc("score"), "id").limit(working // 2)
        worst = rising.withColumn("side", F.lit(1)).unionByName(falling.withColumn("side", F.lit(-1))).toPandas()
        highest, lowest = worst[worst["side"] == 1]["score"].max(), worst[worst["side"] == -1]["score"].min()
        left = float(highest - lowest) if len(worst) and np.isfinite(highest) and np.isfinite(lowest) else 0.0
        if left <= gap or passes == most_passes:
            break
        worst = worst.drop_duplicates("id")
        x, y, alpha = np.stack(worst["x"].to_numpy()), worst["y"].to_numpy(), worst["alpha"].to_numpy()
        after = solved(kernel(x, x, gamma), y, alpha, worst["sum"].to_numpy(), c, gap / 4)
        if np.array_equal(after, alpha):  # what is left are rounding errors
            break
        table = moved(table, x, y, alpha, after, worst["id"].to_numpy())
        passes += 1
    inside = (F.col("alpha") > 0) & (F.col("alpha") < c)
    free = table.where("y <> 0").agg(F.avg(F.when(inside, score)).alias("b")).first()["b"]
    if free is None:
        free = (highest + lowest) / 2 if len(worst) and np.isfinite(highest + lowest) else 0.0
    return Machine(table, float(free), max(left, 0.0), passes)
