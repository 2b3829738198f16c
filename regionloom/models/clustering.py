"""K-means on standardized features, and cluster profiles.

The start oversamples: a few rounds each take points in proportion to their squared distance from the points taken before
(k-means||), and the points, weighted by the rows they stand for, are clustered on the driver, where their number is
bounded. Lloyd's steps then run over the rows. Every row is staged with its cluster and its margin, the distance to the
second nearest centre less that to the nearest. While the centres have moved by less than its margin allows, a row is
settled: its part of the sums comes from a small table of sums by cluster and band of margins, and it is not measured again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from regionloom.operators.columns import complete_cases, normalize
from regionloom.session import stage

#: Points taken in each round of the start, for each cluster, and the rounds.
OVERSAMPLE, START_ROUNDS = 32, 4
#: Starts that are tried on the weighted points.
RESTARTS = 16
#: Lloyd's steps end when the squared moves of the centres add up to this share of the features' mean variance.
TOLERANCE, MOST_ROUNDS = 1e-4, 300
#: Rows whose silhouette is taken, against all rows.
SILHOUETTE_ROWS = 1024
_BANDS = 8
_SLACK = 1e-9


@dataclass
class Clusters:
    k: int
    labels: DataFrame
    centers: list[list[float]]
    inertia: float
    silhouette: float
    iterations: int = 0


def assigned(rows: DataFrame, features: list[str], centers: list[list[float]]) -> DataFrame:
    """Nearest of the given centres (``cluster``, the first of equals) and the square of its distance (``__square``)."""
    squares = F.array(
        *[sum(((F.col(f) - F.lit(c)) * (F.col(f) - F.lit(c)) for f, c in zip(features, center)), F.lit(0.0)) for center in centers]
    )
    with_squares = rows.withColumn("__squares", squares).withColumn("__square", F.array_min("__squares"))
    nearest = (F.array_position("__squares", F.col("__square")) - 1).cast("int")
    return with_squares.withColumn("cluster", nearest).drop("__squares")


def _points(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])


def _slices(batches, size: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1) - 2 * x @ centers.T, 0)


def _nearest(far: np.ndarray) -> np.ndarray:
    """The first of the nearest centres, also where distances are equal but for the last digits: these hang on the order of
    the sums by which features were scaled."""
    return (far <= far.min(axis=1, keepdims=True) * (1 + 1e-9) + 1e-12).argmax(axis=1)


def _raw(features: list[str]) -> list[str]:
    """The columns before scaling. Hashes take these: the last digits of scaled ones hang on the order of sums."""
    return [f"__raw_{f}" for f in features]


def _taken(points: DataFrame, features: list[str], known: np.ndarray, most: int, turn: int, seed: int) -> np.ndarray:
    """``most`` points in proportion to their squared distance from the known ones, none twice: the largest keys."""

    def keyed(batches):
        for batch in _slices(batches):
            square = _squares(_points(batch, features), known).min(axis=1)
            with np.errstate(divide="ignore"):
                key = np.where(square > 1e-18, square / -np.log(batch.column("__u").to_numpy()), 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(f) for f in features], pa.array(key)], names=[*features, "__key"])

    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + turn), *_raw(features)), 11).cast("double") + 0.5) / float(1 << 53)
    kinds = ", ".join(f"`{f}` double" for f in features)
    keys = points.select(*features, u.alias("__u")).mapInArrow(keyed, f"{kinds}, __key double").where("__key > 0")
    rows = keys.orderBy(F.desc("__key"), *features).limit(most).collect()
    return np.array([[r[f] for f in features] for r in rows]).reshape(len(rows), len(features))


def _start(points: DataFrame, features: list[str], k: int, seed: int) -> np.ndarray:
    """Centres of the weighted points of the oversampling rounds."""
    first = points.orderBy(F.xxhash64(F.lit(seed), *_raw(features)), *features).select(*features).limit(1).collect()
    known = np.array([[float(v) for v in first[0]]])
    for turn in range(START_ROUNDS):
        found = np.unique(_taken(points, features, known, OVERSAMPLE * k, turn, seed), axis=0)
        if not len(found):
            break
        known = np.concatenate([known, found])

    def counted(batches):
        total = np.zeros(len(known), np.int64)
        for batch in _slices(batches):
            total += np.bincount(_nearest(_squares(_points(batch, features), known)), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(known))), pa.array(total)], names=["at", "n"])

    counts = points.select(*features).mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    weights = np.zeros(len(known))
    for r in counts:
        weights[r["at"]] = r["n"]
    return weighted_centers(known, weights, k, seed)


def weighted_centers(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The best of several k-means over a bounded number of weighted points."""
    random = np.random.default_rng(seed)
    points, weights = points[weights > 0], weights[weights > 0]
    if len(points) <= k:
        return points
    best, least = points[:k], np.inf
    for _ in range(RESTARTS):
        centers = points[[random.choice(len(points), p=weights / weights.sum())]]
        while len(centers) < k:
            mass = weights * _squares(points, centers).min(axis=1)
            if not mass.sum() > 0:
                break
            centers = np.concatenate([centers, points[[random.choice(len(points), p=mass / mass.sum())]]])
        cost = np.inf
        while True:
            squares = _squares(points, centers)
            nearest = _nearest(squares)
            now = (weights * squares[np.arange(len(points)), nearest]).sum()
            if not now < cost * (1 - 1e-9):
                break
            cost = now
            for j in np.unique(nearest):
                centers[j] = np.average(points[nearest == j], axis=0, weights=weights[nearest == j])
        if cost < least * (1 - 1e-9):
            best, least = centers, cost
    return best


def _measured(features: list[str], centers: np.ndarray):
    """Add the nearest centre, the margin to the second one, and the band of the margin."""

    def run(batches):
        for batch in _slices(batches):
            d = np.sqrt(_squares(_points(batch, features), centers))
            cluster = _nearest(d)
            two = np.partition(d, 1, axis=1)
            margin = two[:, 1] - two[:, 0]
            columns = [batch.column(name) for name in batch.schema.names if name not in ("cluster", "__margin", "__band")]
            names = [name for name in batch.schema.names if name not in ("cluster", "__margin", "__band")]
            columns += [pa.array(cluster.astype(np.int32)), pa.array(margin), pa.array(band_of(margin))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "cluster", "__margin", "__band"])

    return run


def band_of(margin: np.ndarray) -> np.ndarray:
    """Eight bands for each doubling; ``2 ** (band / 8)`` is not above the margins of a band."""
    return np.floor(np.log2(np.maximum(margin, 1e-12)) * _BANDS).astype(np.int32)


@dataclass
class _Sums:
    """Rows, sums of points and of their squares for each cluster."""

    n: np.ndarray
    total: np.ndarray
    square: np.ndarray

    def inertia(self, centers: np.ndarray) -> float:
        parts = self.square - 2 * (self.total * centers).sum(axis=1) + self.n * (centers**2).sum(axis=1)
        return float(np.maximum(parts, 0).sum())

    def means(self, centers: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.n[:, None] > 0, self.total / self.n[:, None], centers)


def _sums(rows: DataFrame, features: list[str], *by: str) -> DataFrame:
    square = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.sum(square).alias("__q"), *[F.sum(f).alias(f) for f in features])


def _added(parts, features: list[str], k: int) -> _Sums:
    sums = _Sums(np.zeros(k), np.zeros((k, len(features))), np.zeros(k))
    for r in sorted(parts, key=lambda r: (r["cluster"], r["__n"], r["__q"])):
        j = r["cluster"]
        sums.n[j] += r["__n"]
        sums.square[j] += r["__q"]
        sums.total[j] += [r[f] for f in features]
    return sums


class _Rows:
    """The staged rows with their clusters and margins for the centres ``base``."""

    def __init__(self, rows: DataFrame, features: list[str], centers: np.ndarray):
        self.features, self.base, self.k = features, centers, len(centers)
        names = [f for f in rows.schema if f.name not in ("cluster", "__margin", "__band")]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
        self.kinds = f"{kinds}, cluster int, __margin double, __band int"
        # in the order of the margins within each file, so that settled stretches are not read
        self.table = stage(rows.mapInArrow(_measured(features, centers), self.kinds).sortWithinPartitions("__band"))
        self.bands = _sums(self.table, features, "cluster", "__band").collect()
        self.n = sum(r["__n"] for r in self.bands)

    def limits(self, centers: np.ndarray) -> np.ndarray:
        """For each cluster the least band whose rows are all settled."""
        drift = np.sqrt(((centers - self.base) ** 2).sum(axis=1))
        others = np.array([np.delete(drift, j).max() for j in range(self.k)])
        return band_of(drift + others + _SLACK) + 1

    def open(self, centers: np.ndarray) -> Column:
        limits = self.limits(centers)
        test = F.lit(False)
        for j, limit in enumerate(limits):
            test = test | ((F.col("cluster") == j) & (F.col("__band") < int(limit)))
        return (F.col("__band") < int(limits.max())) & test

    def sums(self, centers: np.ndarray) -> tuple[_Sums, float]:
        """Sums for the nearest of ``centers``, and the share of rows that had to be measured."""
        limits = self.limits(centers)
        settled = [r for r in self.bands if r["__band"] >= limits[r["cluster"]]]
        left = self.n - sum(r["__n"] for r in settled)
        if left:
            again = self.table.where(self.open(centers)).select(*self.features).mapInArrow(
                _measured(self.features, centers), ", ".join(f"`{f}` double" for f in self.features) + ", cluster int, __margin double, __band int"
            )
            settled += _sums(again, self.features, "cluster").collect()
        return _added(settled, self.features, self.k), left / max(self.n, 1)

    def labelled(self, centers: np.ndarray) -> DataFrame:
        is_open = self.open(centers)
        again = self.table.where(is_open).mapInArrow(_measured(self.features, centers), self.kinds)
        return self.table.where(~is_open).unionByName(again).drop("__margin", "__band")


def _lloyd(rows: DataFrame, features: list[str], k: int, seed: int, tolerance: float, most_rounds: int) -> tuple[DataFrame, np.ndarray, float, int]:
    centers = _start(rows, features, k, seed)
    centers = np.round(centers[np.lexsort(centers.T[::-1])], 9)
    if len(centers) < 2:
        return rows.withColumn("cluster", F.lit(0)), centers, 0.0, 0
    variances = rows.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    enough = tolerance * float(np.mean([variances[f] for f in features]))
    held, rounds = _Rows(rows, features, centers), 0
    while True:
        sums, share = held.sums(centers)
        rounds += 1
        moved = np.round(sums.means(centers), 9)
        if ((moved - centers) ** 2).sum() <= enough or rounds >= most_rounds:
            break
        centers = moved
        if share > 0.5:  # the margins are used up: measure all rows once more
            held = _Rows(held.table, features, centers)
    # what the last step moves by less than the tolerance still counts
    sums, _ = held.sums(moved)
    return held.labelled(moved), moved, sums.inertia(moved), rounds


def silhouette(labelled: DataFrame, features: list[str], k: int, seed: int = 42, most: int = SILHOUETTE_ROWS) -> float:
    """Mean Euclidean silhouette of the ``most`` rows with the smallest hashes, each against all rows; exact for a
    table of that size. Only sums of distances to each cluster are gathered. A row alone in its cluster has 0."""
    chosen = labelled.select(*features, "cluster").orderBy(F.xxhash64(F.lit(seed), *features), *features, "cluster").limit(most).collect()
    points = np.array([[r[f] for f in features] for r in chosen])
    own = np.array([r["cluster"] for r in chosen])
    if not len(points):
        return 0.0

    def summed(batches):
        total, counts = np.zeros((len(points), k)), np.zeros(k, np.int64)
        for batch in _slices(batches, 2048):
            x, cluster = _points(batch, features), batch.column("cluster").to_numpy()
            counts += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster):
                some = x[cluster == j]
                square = np.zeros((len(points), len(some)))
                for f in range(x.shape[1]):  # differences, not products: copies are at distance 0
                    square += (points[:, f : f + 1] - some[:, f]) ** 2
                total[:, j] += np.sqrt(square).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(points) + 1), k)), pa.array(np.tile(np.arange(k), len(points) + 1)), pa.array(np.append(total.ravel(), counts))],
            names=["at", "cluster", "total"],
        )

    parts = labelled.select(*features, "cluster").mapInArrow(summed, "at long, cluster long, total double")
    total = np.zeros((len(points) + 1, k))
    for r in parts.groupBy("at", "cluster").agg(F.sum("total").alias("total")).collect():
        total[r["at"], r["cluster"]] = r["total"]
    counts = total[-1]
    rows = np.arange(len(points))
    within = total[rows, own] / np.maximum(counts[own] - 1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        means = np.where(counts > 0, total[:-1] / counts, np.inf)
    means[rows, own] = np.inf
    beyond = means.min(axis=1)
    widest = np.maximum(within, beyond)
    score = np.where((counts[own] > 1) & np.isfinite(beyond) & (widest > 0), (beyond - within) / np.where(widest > 0, widest, 1), 0.0)
    return float(score.mean())


def kmeans(
    df: DataFrame, features: list[str], k: int = 6, scale: bool = True, seed: int = 42, keep=(), tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS
) -> Clusters:
    """Labels (column ``cluster``) beside the raw features, centers (6 digits), inertia, silhouette and rounds.

    Lloyd's steps run until the squared moves of the centres add up to ``tolerance`` of the mean variance of the features,
    or ``most_rounds`` are done; ``iterations`` tells how many it took. The silhouette is ``silhouette``'s. k is at most the
    number of rows.
    """
    rows = complete_cases(df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]), features)
    raw = rows.withColumns({name: F.col(f) for name, f in zip(_raw(features), features)})
    scaled = normalize(raw, features) if scale else raw
    scaled = stage(scaled)
    n = scaled.count()
    if n == 0:
        return Clusters(0, scaled.withColumn("cluster", F.lit(None).cast("int")), [], 0.0, 0.0)
    k = max(1, min(k, n))
    if k > 1:
        labelled, found, inertia, rounds = _lloyd(scaled, features, k, seed, tolerance, most_rounds)
        k = len(found)
        centers = [[round(float(v), 6) for v in c] for c in found]
        spread = silhouette(labelled, features, k, seed) if k > 1 else 0.0
    else:
        labelled, rounds = scaled.withColumn("cluster", F.lit(0)), 0
        means = scaled.agg(*[F.avg(f).alias(f) for f in features], *[(F.var_pop(f) * F.count(f)).alias(f"s_{f}") for f in features]).first()
        centers = [[round(means[f], 6) for f in features]]
        inertia, spread = float(sum(means[f"s_{f}"] for f in features)), 0.0
    labels = labelled.select(*keep, *[F.col(f"__raw_{f}").alias(f) for f in features], "cluster")
    return Clusters(k, labels, centers, inertia, spread, rounds)


def cluster_profiles(labels: DataFrame, features: list[str], k: int, cluster: str = "cluster") -> DataFrame:
    """Rows and means (raw units, 4 digits) per cluster; a cluster without rows has n = 0."""
    grouped = labels.groupBy(F.col(cluster).cast("bigint").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f), 4).alias(f"{f}_mean") for f in features]
    )
    numbers = labels.sparkSession.range(k).withColumnRenamed("id", "cluster")
    return numbers.join(grouped, "cluster", "left").fillna(0, subset=["n"])
