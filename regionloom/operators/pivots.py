"""Exact k nearest neighbours in any number of features, by pivots.

A bounded sample of the right points are pivots. Every point belongs to the cell of its nearest pivot, and the distance to it
is kept. The left points are dealt into groups of neighbouring cells; each first meets the innermost right points of its own
cells, which bounds how far its k-th neighbour can be. The triangle inequality then tells, from distances to pivots alone,
which other right points can still be nearer: only the cells and rings within reach of a bound are sent to a group. A crowded
cell is cut into rings of bounded size, and what a group needs into bundles, so no task holds more than a group and a bundle
slice whatever the skew. Where nothing can be pruned (many independent features), what is left is a comparison by blocks;
pairs are never rows. Vectors of a few features are searched by boxes (``boxes``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from regionloom.operators.boxes import MOST_FEATURES, nearest_in_boxes
from regionloom.operators.positions import number_rows
from regionloom.session import stage

MOST_PIVOTS = 1024
#: Left points in a group, right points in a ring of a cell, and in a bundle that a group meets at once.
GROUP_ROWS, RING_ROWS, BUNDLE_ROWS = 8192, 16384, 65536
_SLICE = 2048
#: Distances by matrix products are this exact, relative to the size of the centred points.
_SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


class _Pivots:
    """The pivots along a tour from each to its nearest unvisited one, so that successive cells are near each other."""

    def __init__(self, points: np.ndarray):
        self.shift = points.mean(axis=0)
        centred = points - self.shift
        left, tour = np.arange(len(points)), [0]
        left = left[1:]
        while len(left):
            gaps = ((centred[left] - centred[tour[-1]]) ** 2).sum(axis=1)
            tour.append(int(left[gaps.argmin()]))
            left = left[left != tour[-1]]
        self.points = centred[tour]
        self.squares = (self.points**2).sum(axis=1)
        self.largest = math.sqrt(self.squares.max())
        self.apart = np.sqrt(np.maximum(self.squares[:, None] + self.squares - 2 * self.points @ self.points.T, 0))

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each point to each pivot, and how far off they may be."""
        x = x - self.shift
        squares = (x**2).sum(axis=1)
        d = np.sqrt(np.maximum(squares[:, None] + self.squares - 2 * x @ self.points.T, 0))
        return d, _SLACK * (np.sqrt(squares) + self.largest)


def _assigned(pivots: _Pivots):
    """Add ``cell`` (place of the nearest pivot on the tour) and ``away`` (distance to it)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                d, _ = pivots.distances(_matrix(part.column("v")))
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*part.schema.names, "cell", "away"]
                )

    return run


def _reaches(pivots: _Pivots):
    """Per group and cell within reach: the least and greatest distance to the pivot at which a nearer point may lie."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                d, off = pivots.distances(_matrix(part.column("v")))
                group, cell = part.column("group").to_numpy(), part.column("cell").to_numpy()
                bound = part.column("bound").to_numpy(zero_copy_only=False)[:, None] + 4 * off[:, None]
                own = d[np.arange(len(d)), cell][:, None]
                apart = pivots.apart[cell]
                # points of another cell lie beyond the plane midway between the pivots
                beyond = (d**2 - own**2) / (2 * np.where(apart > 0, apart, np.inf))
                within = (beyond - 4 * off[:, None] * (1 + (d + own) / np.where(apart > 0, apart, np.inf)) <= bound) | (apart == 0)
                low, high = np.where(within, d - bound, np.inf), np.where(within, d + bound, -np.inf)
                for g in np.unique(group):
                    rows = group == g
                    lows, highs = low[rows].min(axis=0), high[rows].max(axis=0)
                    cells = np.flatnonzero(lows <= highs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cells), g)), pa.array(cells.astype(np.int32)), pa.array(lows[cells]), pa.array(highs[cells])],
                        names=["group", "cell", "low", "high"],
                    )

    return run


def _units(batches) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of a sorted stream with equal group, bundle and side."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = np.column_stack([batch.column(c).to_numpy() for c in ("group", "bundle", "side")])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield tuple(keys[a]), batch.slice(a, b - a)


class _Group:
    """Left points with the nearest right points met so far."""

    def __init__(self, parts: list[pa.RecordBatch], need: int, shift: np.ndarray):
        self.spots = np.concatenate([p.column("id").to_numpy() for p in parts])
        self.x = np.concatenate([_matrix(p.column("v")) for p in parts])
        self.bound = np.concatenate([p.column("bound").to_numpy(zero_copy_only=False) for p in parts])
        self.need, self.shift = need, shift
        self.centred = self.x - shift
        self.squares = (self.centred**2).sum(axis=1)
        self.at, self.ids, self.distances = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, ids: np.ndarray, points: np.ndarray) -> None:
        centred = points - self.shift
        squares = (centred**2).sum(axis=1)
        at, who, far = [self.at], [self.ids], [self.distances]
        for a in range(0, len(self.x), _SLICE):
            rows = slice(a, a + _SLICE)
            d = self.squares[rows, None] + squares - 2 * self.centred[rows] @ centred.T
            slack = (_SLACK * _SLACK) * (self.squares[rows] + squares.max())
            limit = np.minimum(self.bound[rows] ** 2, np.partition(d, self.need - 1, axis=1)[:, self.need - 1] if d.shape[1] > self.need else np.inf)
            i, j = np.nonzero(d <= (limit * (1 + _SLACK) + slack)[:, None])
            for b in range(0, len(i), 1 << 16):  # bounded copies of the points of the pairs that are left
                i_, j_ = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
                at.append(i_ + a)
                who.append(ids[j_])
                far.append(np.sqrt(((self.x[i_ + a] - points[j_]) ** 2).sum(axis=1)))
        at, who, far = np.concatenate(at), np.concatenate(who), np.concatenate(far)
        order = np.lexsort((who, far, at))
        at, who, far = at[order], who[order], far[order]
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        kept = rank < self.need
        self.at, self.ids, self.distances = at[kept], who[kept], far[kept]
        full = rank == self.need - 1
        self.bound[at[full]] = np.minimum(self.bound[at[full]], far[full])

    def found(self) -> pa.RecordBatch:
        columns = [pa.array(self.spots[self.at]), pa.array(self.ids), pa.array(self.distances)]
        return pa.RecordBatch.from_arrays(columns, names=["spot", "neighbour_id", "distance"])


_FOUND = "spot long, neighbour_id long, distance double"


def _met(need: int, shift: np.ndarray):
    def run(batches):
        key, parts, group = None, [], None
        for (g, bundle, side), part in _units(batches):
            if (g, bundle) != key:
                if group is not None:
                    yield group.found()
                key, parts, group = (g, bundle), [], None
            if side == 0:
                parts.append(part)
                continue
            if group is None:
                group = _Group(parts, need, shift)
            for a in range(0, part.num_rows, _SLICE):
                some = part.slice(a, _SLICE)
                group.meet(some.column("id").to_numpy(), _matrix(some.column("v")))
        if group is not None:
            yield group.found()

    return run


def _compared(pairs: DataFrame, spots: DataFrame, rights: DataFrame, need: int, shift: np.ndarray) -> DataFrame:
    """The nearest right points of each left point among the rings that its group is paired with."""
    before = Window.partitionBy("group").orderBy("cell", "ring").rowsBetween(Window.unboundedPreceding, -1)
    bundle = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / BUNDLE_ROWS).cast("long")
    bundled = stage(pairs.select("group", "cell", "ring", bundle.alias("bundle")))
    asked = spots.join(bundled.select("group", "bundle").distinct(), "group")
    asked = asked.select("group", "bundle", F.lit(0).alias("side"), F.col("spot").alias("id"), "v", "bound")
    met = rights.join(bundled, ["cell", "ring"]).select("group", "bundle", F.lit(1).alias("side"), "id", "v", F.lit(0.0).alias("bound"))
    both = asked.unionByName(met).repartition("group", "bundle").sortWithinPartitions("group", "bundle", "side")
    return both.mapInArrow(_met(need, shift), _FOUND)


def _home_cells(counts: dict[int, int], pivots: _Pivots, need: int) -> list[tuple[int, int]]:
    """Each cell with itself and its next cells, until their innermost rings have enough points for a bound."""
    order = pivots.apart.argsort(axis=1, kind="stable")
    home = []
    for cell in range(len(order)):
        enough = 0
        for other in [cell, *order[cell][order[cell] != cell]]:
            home.append((cell, int(other)))
            enough += min(counts.get(int(other), 0), RING_ROWS)
            if enough >= need:
                break
    return home


def _nearest_by_pivots(spots: DataFrame, rights: DataFrame, n: int, features: int, need: int) -> DataFrame:
    """(spot, neighbour_id, distance): among them are the ``need`` nearest right rows of every spot, ties by id."""
    spark = spots.sparkSession
    sampled = rights.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(min(MOST_PIVOTS, math.ceil(2 * math.sqrt(n)))).collect()
    pivots = _Pivots(np.array([r["v"] for r in sampled], np.float64))

    away = rights.mapInArrow(_assigned(pivots), "id long, v array<double>, cell int, away double")
    ringed = number_rows(away, ["away", "id"], ["cell"], "place").withColumn("ring", F.floor(F.col("place") / RING_ROWS).cast("long"))
    ringed = stage(ringed.drop("place"))
    rings = stage(ringed.groupBy("cell", "ring").agg(F.min("away").alias("least"), F.max("away").alias("most"), F.count(F.lit(1)).alias("n")))
    inner = {r["cell"]: r["n"] for r in rings.where("ring = 0").collect()}  # at most one row for each pivot

    dealt = spots.mapInArrow(_assigned(pivots), "v array<double>, spot long, cell int, away double")
    dealt = number_rows(dealt, ["cell", "away", "spot"], name="place").withColumn("group", F.floor(F.col("place") / GROUP_ROWS).cast("long"))
    dealt = stage(dealt.drop("place"))
    home = spark.createDataFrame(_home_cells(inner, pivots, need), "own int, cell int")
    own = dealt.select("group", F.col("cell").alias("own")).distinct()
    first = own.join(home, "own").select("group", "cell").distinct().join(rings.where("ring = 0"), "cell")
    first = stage(first.select("group", "cell", "ring", "n"))
    found = stage(_compared(first, dealt.withColumn("bound", F.lit(float("inf"))), ringed, need, pivots.shift))

    bounds = found.groupBy("spot").agg(F.count(F.lit(1)).alias("c"), F.max("distance").alias("far"))
    bounds = bounds.select("spot", F.when(F.col("c") >= need, F.col("far")).alias("far"))
    bounded = stage(dealt.join(bounds, "spot", "left").withColumn("bound", F.coalesce("far", F.lit(float("inf")))).drop("far"))
    reach = bounded.select("v", "group", "cell", "bound").mapInArrow(_reaches(pivots), "group long, cell int, low double, high double")
    reach = reach.groupBy("group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    more = reach.join(rings, "cell").where("least <= high AND most >= low").select("group", "cell", "ring", "n")
    more = stage(more.join(first, ["group", "cell", "ring"], "left_anti"))
    if not more.isEmpty():
        found = found.unionByName(_compared(more, bounded, ringed, need, pivots.shift))
    return found


def nearest_vectors(
    left: DataFrame, right: DataFrame, vector: str, k: int, row_id: str = "id", exclude_same_id: bool = False
) -> DataFrame:
    """(id, neighbour_id, distance, rank): the k closest right rows of every left row by the Euclidean distance of their
    vectors (arrays of numbers), ties by id; exact whatever the distribution. Ids are whole numbers.

    Vectors that are NULL, hold a NULL or non-finite number, or are not as long as the longest of the right table have no
    neighbours and are none. With fewer than k right rows all of them are given. ``exclude_same_id`` leaves out the row
    itself, for searches of a table in itself.
    """
    spark = left.sparkSession
    need = k + 1 if exclude_same_id else k
    longest = right.agg(F.max(F.size(vector))).first()[0]
    empty = spark.createDataFrame([], "id long, neighbour_id long, distance double, rank int")
    if not longest or longest < 1 or k < 1:
        return empty

    def finite(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return rows.where((F.size("v") == longest) & fits & F.col("id").isNotNull())

    # of one place only the smallest ids can be among the nearest; Spark limits them in each task before they travel
    copies = Window.partitionBy("v").orderBy("id")
    rights = finite(right).withColumn("__r", F.row_number().over(copies)).where(F.col("__r") <= need).drop("__r")
    rights = stage(rights)
    lefts = stage(finite(left))
    spots = stage(lefts.groupBy("v").agg(F.count(F.lit(1)).alias("w")).select("v", F.monotonically_increasing_id().alias("spot")))
    n = rights.count()
    if n == 0:
        return empty
    by = nearest_in_boxes if longest <= MOST_FEATURES else _nearest_by_pivots
    found = by(spots, rights, n, longest, need)
    best = Window.partitionBy("spot").orderBy("distance", "neighbour_id")
    best = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= need)
    of_spot = best.join(spots, "spot").select(F.col("v").alias("at"), "neighbour_id", "distance", "rank")
    rows = lefts.join(of_spot, F.col("v") == F.col("at")).select("id", "neighbour_id", "distance", "rank")
    if not exclude_same_id:
        return rows
    # the row itself, if it is among them, moves those behind it one place up
    others = Window.partitionBy("id").orderBy("distance", "neighbour_id")
    ranked = rows.where(F.col("id") != F.col("neighbour_id")).withColumn("rank", F.row_number().over(others))
    return ranked.where(F.col("rank") <= k)
