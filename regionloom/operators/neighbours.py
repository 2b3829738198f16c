"""Nearest, k-nearest and within-radius joins that split crowded places.

Points are put on a cube grid with a Morton key, so that the cell of any level is a shift of the key. A search keeps
a table of cell pairs, starting coarse. In each round the pairs are split into the next finer cells, and the
bounding boxes of the points in them decide: pairs that cannot matter are dropped, pairs that are fully decided are
counted without looking at their points, small ones go to the final join, and only crowded ones are split again. All
of it is equi joins and grouped aggregates on Spark, rounds are staged tables, and the number of rounds grows with
the logarithm of the density. Equal places are merged first, so copies cost nothing.

Geographic points are placed on the unit sphere in three dimensions: straight-line distance grows with great-circle
distance there, and neither the poles nor the date line need a special case. Feature spaces have up to three axes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from regionloom.functions import geo
from regionloom.functions.scalars import known
from regionloom.operators.pivots import nearest_vectors
from regionloom.session import stage

BITS = 20
# the first round pairs all occupied cells of its level: at most 64^3 on average for any number of points
FIRST_LEVEL = {1: 6, 2: 4, 3: 3}
STEP = 1
# a cell goes to the final join when it needs at most this many comparisons of points
SMALL_PRODUCT = 16_384
# longest candidate array
CHUNK = 1_024
AXES = ("x", "y", "z")

# Masks that spread 21 bits to every third bit of a long.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _spread(c: Column) -> Column:
    for shift, mask in _SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def _with_key(points: DataFrame, box) -> DataFrame:
    """Add the Morton key ``m`` of the finest level."""
    low, width = box
    top = (1 << BITS) - 1
    parts = []
    for i, axis in enumerate(AXES):
        cell = F.floor((F.col(axis) - F.lit(low[i])) / F.lit(width) * top).cast("bigint")
        cell = F.least(F.greatest(cell, F.lit(0).cast("bigint")), F.lit(top).cast("bigint"))
        parts.append(F.shiftleft(_spread(cell), i))
    return points.withColumn("m", parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]))


def _box(*tables: DataFrame):
    """Lower corner and widest extent over all tables (one row per table comes to the driver)."""
    spans = [F.min(a).alias(f"lo_{a}") for a in AXES] + [F.max(a).alias(f"hi_{a}") for a in AXES]
    rows = [t.agg(*spans).first() for t in tables]
    rows = [r for r in rows if r["lo_x"] is not None]
    if not rows:
        return (0.0, 0.0, 0.0), 1.0
    low = [min(r[f"lo_{a}"] for r in rows) for a in AXES]
    high = [max(r[f"hi_{a}"] for r in rows) for a in AXES]
    return low, max(*(h - l for h, l in zip(high, low)), 1e-12)


def _prepare(*tables: DataFrame) -> list[DataFrame]:
    box = _box(*tables)
    return [stage(_with_key(t, box)) for t in tables]


def _cell(m: str | Column, level: int) -> Column:
    return F.shiftright(m, 3 * (BITS - level))


def _cells(points: DataFrame, level: int, parent_level: int, side: str) -> DataFrame:
    """The occupied cells of a level: points, weight, bounding box, and the cell they came from."""
    cell = _cell("m", level)
    spans = [F.min(a).alias(f"{side}lo_{a}") for a in AXES] + [F.max(a).alias(f"{side}hi_{a}") for a in AXES]
    grouped = points.groupBy(F.col("g").alias(f"{side}g"), cell.alias(f"{side}c")).agg(
        F.count(F.lit(1)).alias(f"{side}n"), F.sum("w").alias(f"{side}w"), *spans
    )
    return grouped.withColumn(f"{side}p", F.shiftright(f"{side}c", 3 * (level - parent_level)))


def _gap() -> Column:
    """Square of the least distance between the two boxes."""
    total = F.lit(0.0)
    for a in AXES:
        d = F.greatest(F.lit(0.0), F.col(f"llo_{a}") - F.col(f"rhi_{a}"), F.col(f"rlo_{a}") - F.col(f"lhi_{a}"))
        total = total + d * d
    return total


def _reach() -> Column:
    """Square of the greatest distance between the two boxes."""
    total = F.lit(0.0)
    for a in AXES:
        d = F.greatest(F.abs(F.col(f"lhi_{a}") - F.col(f"rlo_{a}")), F.abs(F.col(f"rhi_{a}") - F.col(f"llo_{a}")))
        total = total + d * d
    return total


def _levels(dimensions: int):
    level, before = FIRST_LEVEL[dimensions], 0
    while True:
        yield level, before
        if level == BITS:
            return
        before, level = level, min(level + STEP, BITS)


def _within(bound: Column) -> Column:
    return F.col("gap") <= bound * (1 + 1e-9) + 1e-15


def _split(active: DataFrame, left: DataFrame, right: DataFrame, level: int, before: int) -> DataFrame:
    lefts = _cells(left, level, before, "l")
    rights = _cells(right, level, before, "r")
    bounded = "bound" in active.columns
    pairs = active.select(
        F.col("lg").alias("alg"), F.col("rg").alias("arg"), F.col("lc").alias("alc"), F.col("rc").alias("arc"), *[F.col("bound").alias("abound")] * bounded
    )
    joined = pairs.join(lefts, (F.col("alg") == F.col("lg")) & (F.col("alc") == F.col("lp")))
    joined = joined.join(rights, (F.col("arg") == F.col("rg")) & (F.col("arc") == F.col("rp")))
    measured = joined.withColumns({"gap": _gap(), "reach": _reach()})
    # enough points lie within the bound of the cell above, so pairs beyond it need not travel to be ranked
    return measured.where(F.col("abound").isNull() | _within(F.col("abound"))).drop("abound") if bounded else measured


def _at_levels(points: DataFrame, levels: list[int], side: str, *columns: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(v).alias("level"), _cell("m", v).alias(f"{side}c")) for v in levels])
    renamed = [F.col(c).alias(f"{side}_{c}") for c in columns]
    return points.select(F.col("g").alias(f"{side}g"), *renamed, F.inline(cells))


def _roots(left: DataFrame, right: DataFrame, keep: Column | None) -> DataFrame:
    """One root pair per pair of groups; the groups are few (source keys), never data rows."""
    zero = F.lit(0).cast("bigint")
    lefts = left.groupBy(F.col("g").alias("lg")).agg(zero.alias("lc"))
    rights = right.groupBy(F.col("g").alias("rg")).agg(zero.alias("rc"))
    roots = lefts.join(rights, F.col("lc") == F.col("rc"))
    return roots if keep is None else roots.where(keep)


def _candidates(left: DataFrame, right: DataFrame, need: int, cap: int, keep: Column | None, dimensions: int) -> list[tuple[int, DataFrame]]:
    """Cell pairs that may hold one of the ``need`` nearest points: [(level, pairs)]."""
    active = _roots(left, right, keep)
    per_cell = Window.partitionBy("lg", "lc", "rg")
    by_reach = per_cell.orderBy("reach", "rc")
    done = []
    for level, before in _levels(dimensions):
        pairs = _split(active, left, right, level, before)
        ranked = pairs.withColumn("__upto", F.sum("rn").over(by_reach))
        bound = F.min(F.when(F.col("__upto") >= need, F.col("reach"))).over(per_cell)
        useful = ranked.withColumn("__bound", bound).where(
            F.col("__bound").isNull() | _within(F.col("__bound"))
        )
        load = F.sum("rn").over(per_cell)
        few = (F.col("__load") <= cap) | (F.col("ln") * F.col("__load") <= SMALL_PRODUCT)
        small = F.lit(True) if level == BITS else few
        kept = stage(
            useful.withColumn("__load", load).select("lg", "lc", "rg", "rc", F.col("__load").alias("load"), F.col("__bound").alias("bound"), small.alias("small"))
        )
        done.append((level, kept.where("small")))
        active = kept.where("NOT small")
        if active.isEmpty():
            break
    return [(level, pairs.withColumn("level", F.lit(level))) for level, pairs in done]


def _pick(left: DataFrame, right: DataFrame, rounds, left_columns, right_columns) -> DataFrame:
    """Every left point beside the right points of its candidate cells."""
    levels = [level for level, _ in rounds]
    pairs = reduce(DataFrame.unionByName, [p for _, p in rounds]).select("level", "lg", "lc", "rg", "rc")
    beside = pairs.join(_at_levels(right, levels, "r", *right_columns), ["level", "rg", "rc"])
    return beside.join(_at_levels(left, levels, "l", *left_columns), ["level", "lg", "lc"])


# ---------------------------------------------------------------- geographic points


def places(df: DataFrame, lat: str, lon: str, group: str | None = None, weight: str | None = None) -> DataFrame:
    """The distinct places of a table with their number of rows, on the unit sphere."""
    g = F.col(group).cast("string") if group else F.lit("")
    placed = [F.col(c).isNotNull() & ~F.isnan(c) for c in (lat, lon)]
    counted = df.where(placed[0] & placed[1]).groupBy(g.alias("g"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("w")
    )
    x, y, z = geo.unit_vector("lat", "lon")
    return counted.withColumns({"x": x, "y": y, "z": z})


def _nearest_table(left: DataFrame, right: DataFrame, earth: float, keep: Column | None = None) -> DataFrame:
    """(lg, l_lat, l_lon, rg, km) for places: the least distance to each right group."""
    left, right = _prepare(left, right)
    rounds = _candidates(left, right, need=1, cap=512, keep=keep, dimensions=2)
    beside = _pick(left, right, rounds, ["lat", "lon", "w"], ["lat", "lon"])
    km = geo.haversine("l_lat", "l_lon", "r_lat", "r_lon", earth)
    return beside.groupBy("lg", "l_lat", "l_lon", "l_w", "rg").agg(F.min(km).alias("km"))


def nearest(
    left: DataFrame,
    right: DataFrame,
    lat: str = "latitude",
    lon: str = "longitude",
    new: str = "nearest_km",
    earth: float = geo.EARTH_KM,
) -> DataFrame:
    """``left`` with the distance to the closest point of ``right``; NULL without a place or without any right point."""
    found = _nearest_table(places(left, lat, lon), places(right, lat, lon), earth)
    found = found.select(F.col("l_lat").alias("__lat"), F.col("l_lon").alias("__lon"), F.col("km").alias(new))
    same = (F.col(lat) == F.col("__lat")) & (F.col(lon) == F.col("__lon"))
    return left.join(found, same, "left").drop("__lat", "__lon")


def region_distances(obs: DataFrame, lat="latitude", lon="longitude", group="source_key", earth: float = geo.EARTH_KM) -> DataFrame:
    """Per ordered pair of sources: mean and least distance from a row of ``source_a`` to its closest row of
    ``source_b``, and the distance of the mean places (choice ours)."""
    spots = places(obs, lat, lon, group)
    found = _nearest_table(spots, spots, earth, keep=F.col("lg") != F.col("rg"))
    pairs = found.groupBy(F.col("lg").alias("source_a"), F.col("rg").alias("source_b")).agg(
        (F.sum(F.col("km") * F.col("l_w")) / F.sum("l_w")).alias("mean_nearest_km"), F.min("km").alias("min_km")
    )
    centres = obs.groupBy(F.col(group).alias("s")).agg(F.avg(known(lat)).alias("clat"), F.avg(known(lon)).alias("clon"))
    a = centres.select(F.col("s").alias("source_a"), F.col("clat").alias("alat"), F.col("clon").alias("alon"))
    b = centres.select(F.col("s").alias("source_b"), F.col("clat").alias("blat"), F.col("clon").alias("blon"))
    return pairs.join(a, "source_a").join(b, "source_b").select(
        "source_a", "source_b", "mean_nearest_km", "min_km",
        geo.haversine("alat", "alon", "blat", "blon", earth).alias("centroid_km"),
    )


def _chord(km: float, earth: float) -> float:
    return 2.0 * math.sin(min(km / earth, math.pi) / 2.0)


def _range_rounds(left, right, chords: list[float], cap: int, keep: Column | None, listing: bool, half: bool = False):
    """[(level, staged pairs)] with ``state``: ``inside`` (decided for every radius) or ``points`` (to be compared).

    ``half`` keeps one of the two orders of each pair of cells, for searches of a table in itself.
    """
    active = _roots(left, right, keep)
    slack = 1e-9
    outer = (chords[-1] * (1 + slack)) ** 2 + 1e-15
    contained = [F.col("reach") <= (c * (1 - slack)) ** 2 for c in chords]
    apart = [F.col("gap") > (c * (1 + slack)) ** 2 + 1e-15 for c in chords]
    settled = reduce(lambda a, b: a & b, [i | o for i, o in zip(contained, apart)])
    hits = F.array(*[F.when(i, F.col("rw")).otherwise(F.lit(0)) for i in contained])
    done = []
    for level, before in _levels(2):
        pairs = _split(active, left, right, level, before).where(F.col("gap") <= outer)
        pairs = pairs.where("lc <= rc") if half else pairs
        small = F.lit(True) if level == BITS else F.col("ln") * F.col("rn") <= cap
        state = F.when(small, "points").otherwise("split")
        if not listing:
            state = F.when(settled, "inside").otherwise(state)
        kept = stage(pairs.select("lg", "lc", "lw", "rg", "rc", hits.alias("hits"), state.alias("state")))
        done.append((level, kept))
        active = kept.where("state = 'split'")
        if active.isEmpty():
            break
    return done


def within_counts(
    left: DataFrame,
    right: DataFrame,
    radii_km: list[float],
    lat: str = "latitude",
    lon: str = "longitude",
    earth: float = geo.EARTH_KM,
    prefix: str = "count_within_",
) -> DataFrame:
    """``left`` with the number of ``right`` rows within each radius (0 without a place)."""
    radii = sorted(radii_km)
    names = [f"__within_{i}" for i in range(len(radii))]
    a, b = _prepare(places(left, lat, lon), places(right, lat, lon))
    rounds = _range_rounds(a, b, [_chord(r, earth) for r in radii], SMALL_PRODUCT, None, listing=False)
    levels = [level for level, _ in rounds]
    tagged = [p.withColumn("level", F.lit(level)) for level, p in rounds]
    whole = reduce(DataFrame.unionByName, tagged)
    # cells that lie wholly inside or outside: their totals reach the left points through the cell
    sums = [F.sum(F.get("hits", F.lit(i))).alias(n) for i, n in enumerate(names)]
    by_cell = whole.where("state = 'inside'").groupBy("level", "lg", "lc").agg(*sums)
    through = _at_levels(a, levels, "l", "lat", "lon").join(by_cell, ["level", "lg", "lc"]).select("l_lat", "l_lon", *names)
    open_pairs = whole.where("state = 'points'").select("level", "lg", "lc", "rg", "rc")
    beside = open_pairs.join(_at_levels(b, levels, "r", "lat", "lon", "w"), ["level", "rg", "rc"]).join(
        _at_levels(a, levels, "l", "lat", "lon"), ["level", "lg", "lc"]
    )
    km = geo.haversine("l_lat", "l_lon", "r_lat", "r_lon", earth)
    compared = beside.withColumn("km", km).where(F.col("km") <= radii[-1])
    compared = compared.select(
        "l_lat", "l_lon", *[F.when(F.col("km") <= r, F.col("r_w")).otherwise(F.lit(0)).alias(n) for r, n in zip(radii, names)]
    )
    totals = through.unionByName(compared).groupBy("l_lat", "l_lon").agg(*[F.sum(n).alias(n) for n in names])
    same = (F.col(lat) == F.col("l_lat")) & (F.col(lon) == F.col("l_lon"))
    counts = [F.coalesce(n, F.lit(0)).cast("bigint").alias(f"{prefix}{r:g}km") for n, r in zip(names, radii)]
    return left.join(totals, same, "left").select(*[left[f"`{c}`"] for c in left.columns], *counts)


def geometry_intersections(
    obs: DataFrame, radius_km: float, lat="latitude", lon="longitude", group="source_key", earth: float = geo.EARTH_KM
) -> DataFrame:
    """Per unordered pair of sources: how many pairs of their rows lie within the radius (choice ours).

    Crowded cells that lie within reach of each other are multiplied, not enumerated.
    """
    (spots,) = _prepare(places(obs, lat, lon, group))
    rounds = _range_rounds(spots, spots, [_chord(radius_km, earth)], SMALL_PRODUCT, F.col("lg") < F.col("rg"), listing=False)
    levels = [level for level, _ in rounds]
    whole = reduce(DataFrame.unionByName, [p.withColumn("level", F.lit(level)) for level, p in rounds])
    counted = whole.where("state = 'inside'").select("lg", "rg", (F.col("lw") * F.get("hits", F.lit(0))).alias("n"))
    open_pairs = whole.where("state = 'points'").select("level", "lg", "lc", "rg", "rc")
    beside = open_pairs.join(_at_levels(spots, levels, "r", "lat", "lon", "w"), ["level", "rg", "rc"]).join(
        _at_levels(spots, levels, "l", "lat", "lon", "w"), ["level", "lg", "lc"]
    )
    close = beside.where(geo.haversine("l_lat", "l_lon", "r_lat", "r_lon", earth) <= radius_km)
    compared = close.select("lg", "rg", (F.col("l_w") * F.col("r_w")).alias("n"))
    total = counted.unionByName(compared).groupBy(F.col("lg").alias("source_a"), F.col("rg").alias("source_b"))
    return total.agg(F.sum("n").cast("bigint").alias("n_pairs")).where("n_pairs > 0")


def adjacency_edges(df: DataFrame, radius_km: float, lat="latitude", lon="longitude", earth: float = geo.EARTH_KM) -> DataFrame:
    """Edges between distinct places within a radius, each once: (lat_a, lon_a, lat_b, lon_b, km).

    Rows at the same place are one node, so copies add no edges.
    """
    (spots,) = _prepare(places(df, lat, lon))
    rounds = _range_rounds(spots, spots, [_chord(radius_km, earth)], 65_536, None, listing=True, half=True)
    levels = [level for level, _ in rounds]
    whole = reduce(DataFrame.unionByName, [p.withColumn("level", F.lit(level)) for level, p in rounds])
    open_pairs = whole.where("state = 'points'").select("level", "lg", "lc", "rg", "rc")
    beside = open_pairs.join(_at_levels(spots, levels, "r", "lat", "lon"), ["level", "rg", "rc"]).join(
        _at_levels(spots, levels, "l", "lat", "lon"), ["level", "lg", "lc"]
    )
    left, right = (F.struct(F.col(f"{s}_lat").alias("lat"), F.col(f"{s}_lon").alias("lon")) for s in "lr")
    # two cells met in one order only; inside a cell both orders of a pair are there
    ordered = beside.where((F.col("lc") < F.col("rc")) | (left < right)).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
    km = geo.haversine("a.lat", "a.lon", "b.lat", "b.lon", earth)
    return ordered.select(
        F.col("a.lat").alias("lat_a"), F.col("a.lon").alias("lon_a"), F.col("b.lat").alias("lat_b"), F.col("b.lon").alias("lon_b"), km.alias("km")
    ).where(F.col("km") <= radius_km)


# ---------------------------------------------------------------- feature space


def _feature_points(df: DataFrame, features: list[str], row_id: str, copies: int) -> DataFrame:
    """At most ``copies`` rows (smallest ids) of each place: more of them can never be among the nearest."""
    zero = F.lit(0.0)
    axes = [F.col(f).cast("double").alias(a) for f, a in zip(features, AXES)]
    axes += [zero.alias(a) for a in AXES[len(features):]]
    rows = df.select(F.lit("").alias("g"), F.col(row_id).alias("id"), *axes, F.lit(1).cast("bigint").alias("w"))
    for a in AXES:
        rows = rows.where(F.col(a).isNotNull() & ~F.isnan(a))
    if not copies:
        return rows
    first = Window.partitionBy(*AXES).orderBy("id")
    return rows.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= copies).drop("__r")


def k_nearest(
    left: DataFrame, right: DataFrame, features: list[str] | str, k: int, row_id: str, exclude_same_id: bool = False
) -> DataFrame:
    """(id, neighbour_id, distance, rank): the k closest right rows of every left row in Euclidean distance over
    any number of features, ties by id. A row without one of its features (NULL, NaN) has no neighbours and is none.

    Up to three features are searched by cells in SQL expressions, more of them, or one column of arrays, by pivots
    (``pivots.nearest_vectors``).
    """
    if not features:
        raise ValueError("at least one feature")
    if isinstance(features, str):
        return nearest_vectors(left, right, features, k, row_id, exclude_same_id)
    if len(features) > 3:
        left, right = (t.select(row_id, F.array(*[F.col(f).cast("double") for f in features]).alias("__v")) for t in (left, right))
        return nearest_vectors(left, right, "__v", k, row_id, exclude_same_id)
    need = k + 1 if exclude_same_id else k
    lefts = _feature_points(left, features, row_id, 0)
    spots = lefts.groupBy("g", *AXES).agg(F.count(F.lit(1)).alias("w"))
    a, b = _prepare(spots, _feature_points(right, features, row_id, need))
    rounds = _candidates(a, b, need=need, cap=max(512, 32 * need), keep=None, dimensions=len(features))
    per_spot = _closest(a, b, rounds, need)
    rows = lefts.select("id", *AXES).join(per_spot, list(AXES))
    if not exclude_same_id:
        return rows.select("id", "neighbour_id", "distance", F.col("__r").cast("int").alias("rank"))
    # the row itself, if it is among them, moves those behind it one place up
    own = Window.partitionBy("id").orderBy("distance", "neighbour_id")
    others = rows.where(F.col("id") != F.col("neighbour_id"))
    return others.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select(
        "id", "neighbour_id", "distance", "rank"
    )


def _closest(left: DataFrame, right: DataFrame, rounds, need: int) -> DataFrame:
    """(x, y, z, neighbour_id, distance, __r): the closest right points of each left place.

    The candidates of a cell travel as arrays of at most about CHUNK points, so that each left place sorts a small
    array in its own row instead of sending every comparison through a shuffle.
    """
    levels = [level for level, _ in rounds]
    pairs = reduce(DataFrame.unionByName, [p for _, p in rounds]).select("level", "lg", "lc", "rg", "rc", "load")
    pieces = F.ceil(F.col("load") / CHUNK)
    beside = pairs.join(_at_levels(right, levels, "r", "id", *AXES), ["level", "rg", "rc"])
    packed = beside.groupBy("level", "lg", "lc", F.pmod(F.xxhash64("r_id"), pieces).alias("piece")).agg(
        F.collect_list(F.struct("r_id", *[f"r_{c}" for c in AXES])).alias("found")
    )
    met = packed.join(_at_levels(left, levels, "l", *AXES), ["level", "lg", "lc"])

    def measure(p):
        parts = [(p[f"r_{c}"] - F.col(f"l_{c}")) * (p[f"r_{c}"] - F.col(f"l_{c}")) for c in AXES]
        return F.struct((parts[0] + parts[1] + parts[2]).alias("square"), p["r_id"].alias("neighbour_id"))

    best = F.slice(F.array_sort(F.transform("found", measure)), 1, need)
    rows = met.select(*[F.col(f"l_{c}").alias(c) for c in AXES], F.inline(best))
    order = Window.partitionBy(*AXES).orderBy("square", "neighbour_id")
    ranked = rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= need)
    return ranked.select(*AXES, "neighbour_id", F.sqrt("square").alias("distance"), "__r")


def knn_graph(df: DataFrame, features: list[str], k: int, row_id: str, scale: bool = True) -> DataFrame:
    """The k nearest other rows of every row on standardized features; distance rounded to four digits.

    Needs more than k complete rows, otherwise the result is empty.
    """
    from regionloom.operators.columns import complete_cases, normalize

    rows = complete_cases(df.select(row_id, *[F.col(f).cast("double").alias(f) for f in features]), features)
    if scale:
        rows = normalize(rows, features, "zscore")
    rows = stage(rows)
    if rows.count() < k + 1:
        rows = rows.limit(0)
    found = k_nearest(rows, rows, features, k, row_id, exclude_same_id=True)
    return found.withColumn("distance", F.round("distance", 4))


def knn_predict(
    train: DataFrame, query: DataFrame, features: list[str] | str, target: str, k: int = 3, row_id: str = "id", continuous: bool = True
) -> DataFrame:
    """(id, prediction): mean of the k nearest training rows, or their most frequent label (smallest on a tie)."""
    found = k_nearest(query, train, features, k, row_id)
    labels = train.select(F.col(row_id).alias("neighbour_id"), F.col(target).alias("__y"))
    voted = found.join(labels, "neighbour_id")
    if continuous:
        return voted.groupBy("id").agg(F.avg("__y").alias("prediction"))
    votes = voted.groupBy("id", "__y").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("__y")))
    return votes.groupBy("id").agg(best.alias("b")).select("id", F.col("b.__y").alias("prediction"))
