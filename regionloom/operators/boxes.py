"""Exact k nearest neighbours in a few features, by boxes.

A bounded sample of the right points is split at medians until a cell has about ``CELL_ROWS`` of all rows, so cells grow in
number with the table and hold about as many points each, whatever the distribution. A left point first meets the right points
of its own cell, which bounds how far its k-th neighbour can be, and then travels to the cells whose tight box is within that
bound, a few for any size of the table. Inside a cell both sides are cut into small blocks, again at medians, and only blocks
within reach of each other are compared. Pairs are never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regionloom.session import stage

#: Features up to which boxes tell more than distances to pivots do.
MOST_FEATURES = 5
#: Right points in a cell, of the sample at most, and of it in a cell at least.
CELL_ROWS, SAMPLE_ROWS, LEAST_SAMPLED = 8192, 65536, 16
BLOCK_ROWS = 64
#: Left points that look for cells at once.
_SLICE = 2048
#: Squared distances to boxes and in blocks are this exact, and more.
_SLACK = 1 + 1e-9

_MET = "cell int, spot long, v array<double>, bound double, ids array<long>, distances array<double>"


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _arrays(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


class _Tree:
    """Splits of a sample; ``cells`` leaves, each of which holds ``least`` sampled points or more."""

    def __init__(self, points: np.ndarray, rows: int, least: int):
        dim, split, low, high, self.cells = [0], [0.0], [-1], [-1], 0
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, of = todo.pop()
            parted = self._parted(points[of], least) if len(of) * rows > CELL_ROWS * len(points) else None
            if parted is None:
                dim[node], self.cells = -1 - self.cells, self.cells + 1
                continue
            dim[node], split[node], below = parted
            for side, kept in ((low, of[below]), (high, of[~below])):
                side[node] = len(dim)
                todo.append((len(dim), kept))
                dim.append(0), split.append(0.0), low.append(-1), high.append(-1)
        self.dim, self.split, self.low, self.high = np.array(dim), np.array(split), np.array(low), np.array(high)

    @staticmethod
    def _parted(x: np.ndarray, least: int) -> tuple[int, float, np.ndarray] | None:
        for d in (x.max(axis=0) - x.min(axis=0)).argsort()[::-1]:
            middle = np.partition(x[:, d], len(x) // 2)[len(x) // 2]
            above = x[x[:, d] > middle, d]
            for at in (middle, above.min() if len(above) else middle):
                below = x[:, d] < at
                if least <= below.sum() <= len(x) - least:
                    return int(d), float(at), below
        return None

    def of(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[self.dim[at[rows]] >= 0]
            node = at[rows]
            at[rows] = np.where(x[rows, self.dim[node]] < self.split[node], self.low[node], self.high[node])
        return (-1 - self.dim[at]).astype(np.int32)


def _assigned(tree: _Tree):
    def run(batches):
        for batch in batches:
            cell = pa.array(tree.of(_matrix(batch.column("v")))) if batch.num_rows else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=[*batch.schema.names, "cell"])

    return run


def _gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances from each box to each other box."""
    total = np.zeros((len(low), len(lows)))
    for d in range(low.shape[1]):
        total += np.maximum(np.maximum(lows[:, d] - high[:, d, None], low[:, d, None] - highs[:, d]), 0) ** 2
    return total


def _blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of blocks of like points (-1 fills up), and the corners of their boxes."""
    levels = max(0, int(np.ceil(np.log2(len(x) / BLOCK_ROWS))))
    size = -(-len(x) // (1 << levels))
    order = np.concatenate([np.arange(len(x)), np.full((size << levels) - len(x), -1)]).reshape(1, -1)
    for _ in range(levels):
        p = x[order]
        widest = (p.max(axis=1) - p.min(axis=1)).argmax(axis=1)
        keys = np.take_along_axis(p, widest[:, None, None], axis=2)[:, :, 0]
        order = np.take_along_axis(order, keys.argsort(axis=1, kind="stable"), axis=1).reshape(2 * len(order), -1)
    p = x[order]
    return order, p.min(axis=1), p.max(axis=1)


class _Cell:
    """The right points of a cell."""

    def __init__(self, parts: list[pa.RecordBatch], need: int):
        self.ids = np.concatenate([p.column("id").to_numpy() for p in parts])
        self.points = np.concatenate([_matrix(p.column("v")) for p in parts])
        self.need = need
        self.order, self.low, self.high = _blocks(self.points)
        self.filled = (self.order >= 0).sum(axis=1)

    def _squares(self, x: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who = self.order[blocks].ravel()
        who = who[who >= 0]
        points = self.points[who]
        total = np.zeros((len(x), len(who)))
        for d in range(x.shape[1]):
            total += (x[:, d, None] - points[:, d]) ** 2
        return total, who

    def meet(self, x: np.ndarray, bound: np.ndarray):
        """Per block of left points: their rows, and of what they found the place in the block, id and distance."""
        order, low, high = _blocks(x)
        gaps = _gaps(low, high, self.low, self.high)
        for rows, gap in zip(order, gaps, strict=True):
            rows = rows[rows >= 0]
            if not len(rows):
                continue
            points, limit = x[rows], bound[rows] ** 2
            if np.isinf(limit).any():
                near = gap.argsort()
                near = near[: np.searchsorted(np.cumsum(self.filled[near]), self.need) + 1]
                squares, who = self._squares(points, near)
                if len(who) >= self.need:
                    limit = np.minimum(limit, np.partition(squares, self.need - 1, axis=1)[:, self.need - 1])
            squares, who = self._squares(points, np.flatnonzero(gap <= limit.max() * _SLACK))
            at, j = np.nonzero(squares <= limit[:, None] * _SLACK)
            ids = self.ids[who[j]]
            far = np.sqrt(((points[at] - self.points[who[j]]) ** 2).sum(axis=1))
            by = np.lexsort((ids, far, at))
            at, ids, far = at[by], ids[by], far[by]
            first = np.searchsorted(at, np.arange(len(rows)))
            kept = np.arange(len(at)) - first[at] < self.need
            yield rows, at[kept], ids[kept], far[kept]


def _met(need: int):
    """Cells of a sorted stream: right points (side 0), then left points in batches."""

    def run(batches):
        key, parts, cell = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "side")])
            cuts = np.unique([0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), batch.num_rows])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part, (at, side) = batch.slice(a, b - a), keys[a]
                if at != key:
                    key, parts, cell = at, [], None
                if side == 0:
                    parts.append(part)
                    continue
                if cell is None and parts:
                    cell, parts = _Cell(parts, need), []
                x, bound = _matrix(part.column("v")), part.column("bound").to_numpy()
                spots = part.column("id").to_numpy()
                none = ((np.arange(len(x)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)),)
                for rows, who, ids, far in cell.meet(x, bound) if cell else none:
                    ends = np.searchsorted(who, np.arange(len(rows) + 1)).astype(np.int32)
                    reach = bound[rows].copy()
                    full = np.diff(ends) == need
                    reach[full] = np.minimum(reach[full], far[ends[1:][full] - 1])
                    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(values)) for values in (ids, far)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), key, np.int32)), pa.array(spots[rows]), _arrays(x[rows]), pa.array(reach), *lists],
                        names=["cell", "spot", "v", "bound", "ids", "distances"],
                    )

    return run


def _asking(low: np.ndarray, high: np.ndarray, cells: np.ndarray):
    """Left points once for each other cell whose box is within their bound."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, _SLICE):
                part = batch.slice(a, _SLICE)
                x, reach = _matrix(part.column("v")), part.column("bound").to_numpy() ** 2 * _SLACK
                near = np.flatnonzero(_gaps(x.min(axis=0)[None], x.max(axis=0)[None], low, high)[0] <= reach.max())
                asked = _gaps(x, x, low[near], high[near]) <= reach[:, None]
                asked &= part.column("cell").to_numpy()[:, None] != cells[near]
                i, j = np.nonzero(asked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[near][j]), part.column("spot").take(pa.array(i)), _arrays(x[i]), part.column("bound").take(pa.array(i))],
                    names=["cell", "id", "v", "bound"],
                )

    return run


def _compared(lefts: DataFrame, rights: DataFrame, need: int) -> DataFrame:
    asked = lefts.select("cell", F.lit(1).alias("side"), "id", "v", "bound")
    both = rights.select("cell", F.lit(0).alias("side"), "id", "v", F.lit(0.0).alias("bound")).unionByName(asked)
    both = both.repartition("cell").sortWithinPartitions("cell", "side")
    return stage(both.mapInArrow(_met(need), _MET))


def nearest_in_boxes(spots: DataFrame, rights: DataFrame, n: int, features: int, need: int) -> DataFrame:
    """(spot, neighbour_id, distance) of ``spots`` (``spot``, ``v``): among them are the ``need`` nearest of the ``n`` rows of
    ``rights`` (``id``, ``v``), ties by id."""
    sampled = rights.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).toPandas()["v"]
    tree = _Tree(np.stack(sampled.to_numpy()).astype(np.float64), n, max(need, LEAST_SAMPLED))
    filed = stage(rights.select("id", "v").mapInArrow(_assigned(tree), "id long, v array<double>, cell int"))
    corners = [f(F.col("v")[d]) for f in (F.min, F.max) for d in range(features)]
    boxes = np.array([list(r) for r in filed.groupBy("cell").agg(*corners).collect()], np.float64)  # a bounded number of cells
    cells, low, high = boxes[:, 0].astype(np.int32), boxes[:, 1 : 1 + features], boxes[:, 1 + features :]

    own = spots.select(F.col("spot").alias("id"), "v").mapInArrow(_assigned(tree), "id long, v array<double>, cell int")
    home = _compared(own.withColumn("bound", F.lit(float("inf"))), filed, need)
    asked = home.select("cell", "spot", "v", "bound").mapInArrow(_asking(low, high, cells), "cell int, id long, v array<double>, bound double")
    found = home.unionByName(_compared(asked, filed, need))
    return found.select("spot", F.inline(F.arrays_zip("ids", "distances"))).toDF("spot", "neighbour_id", "distance")
