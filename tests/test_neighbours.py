"""Neighbour searches against brute force: whole globe, date line, poles, copies, crowded places."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regionloom.operators import graph, neighbours

KM = 6371.0088


def great_circle(a, b):
    la, lo, lb, ob = (np.radians(v) for v in (a[:, None, 0], a[:, None, 1], b[None, :, 0], b[None, :, 1]))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((ob - lo) / 2) ** 2
    return 2 * KM * np.arcsin(np.sqrt(np.minimum(1, h)))


def globe(n, seed):
    rng = np.random.default_rng(seed)
    return np.column_stack([np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)])


def crowded(n, seed):
    """A third of the rows at one place, a third in a few metres, the rest far apart, some across the date line."""
    rng = np.random.default_rng(seed)
    third = n // 3
    same = np.tile([[42.0, 179.9999]], (third, 1))
    dense = np.column_stack([rng.normal(42.0, 1e-4, third), rng.normal(-179.9999, 1e-4, third)])
    return np.vstack([same, dense, globe(n - 2 * third, seed + 1)])


def frame(spark, points, first=0):
    pdf = pd.DataFrame({"id": np.arange(first, first + len(points)), "latitude": points[:, 0], "longitude": points[:, 1]})
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("make", [globe, crowded])
def test_nearest(spark, make):
    a, b = make(300, 1), make(400, 5)
    got = neighbours.nearest(frame(spark, a), frame(spark, b)).orderBy("id").toPandas()["nearest_km"].to_numpy()
    assert np.allclose(got, great_circle(a, b).min(axis=1), atol=1e-6)


@pytest.mark.parametrize("make", [globe, crowded])
def test_counts(spark, make):
    a, b = make(300, 2), make(400, 7)
    d = great_circle(a, b)
    got = neighbours.within_counts(frame(spark, a), frame(spark, b), [0.05, 500, 3000]).orderBy("id").toPandas()
    for r, name in ((0.05, "count_within_0.05km"), (500, "count_within_500km"), (3000, "count_within_3000km")):
        assert (got[name].to_numpy() == (d <= r).sum(axis=1)).all()


def test_crowded_cells_are_counted_whole(spark, monkeypatch):
    """With a tiny comparison budget all is decided through boxes or at the finest level; results stay the same."""
    monkeypatch.setattr(neighbours, "SMALL_PRODUCT", 8)
    a, b = crowded(120, 3), crowded(150, 9)
    d = great_circle(a, b)
    got = neighbours.within_counts(frame(spark, a), frame(spark, b), [0.02, 1000]).orderBy("id").toPandas()
    assert (got["count_within_0.02km"].to_numpy() == (d <= 0.02).sum(axis=1)).all()
    assert (got["count_within_1000km"].to_numpy() == (d <= 1000).sum(axis=1)).all()


def test_intersections_and_edges(spark):
    points = crowded(240, 4)
    df = frame(spark, points).withColumn("source_key", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")))
    d = great_circle(points, points)
    group = np.arange(len(points)) % 3
    got = {(r[0], r[1]): r[2] for r in neighbours.geometry_intersections(df, 800.0).collect()}
    for x in range(3):
        for y in range(x + 1, 3):
            assert got.get((f"s{x}", f"s{y}"), 0) == (d[np.ix_(group == x, group == y)] <= 800).sum()
    spots = np.unique(points, axis=0)
    near = great_circle(spots, spots) <= 800
    assert neighbours.adjacency_edges(df, 800.0).count() == (near.sum() - len(spots)) // 2


def brute_knn(values, k):
    d = np.sqrt(((values[:, None, :] - values[None, :, :]) ** 2).sum(axis=2))
    out = []
    for i in range(len(values)):
        order = sorted((round(d[i, j], 12), j) for j in range(len(values)) if j != i)[:k]
        out.append([j for _, j in order])
    return out


@pytest.mark.parametrize("axes", [1, 2, 3])
def test_knn_with_copies_and_ties(spark, axes):
    rng = np.random.default_rng(axes)
    values = np.vstack([np.zeros((40, axes)), rng.integers(0, 6, (60, axes)).astype(float), rng.normal(0, 50, (60, axes))])
    names = ["p", "q", "r"][:axes]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(values)), **{c: values[:, i] for i, c in enumerate(names)}}))
    got = neighbours.k_nearest(df, df, names, 4, "id", exclude_same_id=True).toPandas().sort_values(["id", "rank"])
    want = brute_knn(values, 4)
    for i, part in got.groupby("id"):
        assert part["neighbour_id"].tolist() == want[i]


def test_knn_graph_needs_enough_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, x double")
    assert neighbours.knn_graph(df, ["x"], 2, "id").count() == 0
    got = neighbours.knn_graph(df, ["x"], 1, "id").collect()
    assert {(r["id"], r["neighbour_id"], r["distance"]) for r in got} == {(1, 2, 2.0), (2, 1, 2.0)}


def test_knn_predict_votes(spark):
    train = spark.createDataFrame([(1, 0.0, "b"), (2, 0.1, "a"), (3, 9.0, "c"), (4, 9.1, "c")], "id long, x double, y string")
    query = spark.createDataFrame([(10, 0.05), (11, 9.0)], "id long, x double")
    got = dict(neighbours.knn_predict(train, query, ["x"], "y", 2, "id", continuous=False).collect())
    assert got == {10: "a", 11: "c"}


def test_fixture_fires_and_landslides(spark):
    fires = spark.createDataFrame(
        [("F001", 42.21, -121.77), ("F003", 42.40, -121.90), ("F004", 42.10, -121.60)], "id string, latitude double, longitude double"
    )
    slides = np.array([[42.22, -121.75], [42.41, -121.91], [42.12, -121.62]])
    got = dict(neighbours.nearest(fires, frame(spark, slides)).select("id", "nearest_km").collect())
    for i, (lat, lon) in {"F001": (42.21, -121.77), "F003": (42.40, -121.90), "F004": (42.10, -121.60)}.items():
        d = great_circle(np.array([[lat, lon]]), slides)[0]
        assert abs(got[i] - d.min()) < 1e-6 and d.argmin() == {"F001": 0, "F003": 1, "F004": 2}[i]


def test_empty_and_null_places(spark):
    left = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0)], "id long, latitude double, longitude double")
    right = left.where("id = 1")
    got = {r["id"]: r["nearest_km"] for r in neighbours.nearest(left, right).collect()}
    assert got == {1: 0.0, 2: None}
    counts = {r["id"]: r["count_within_1km"] for r in neighbours.within_counts(left, right, [1]).collect()}
    assert counts == {1: 1, 2: 0}


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2)) if a != b} | {(200, i) for i in range(201, 230)} | {(i, i + 1) for i in range(300, 340)}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = dict(graph.components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect())
    assert got == {x: root(x) for x in parent}


def test_a_nan_place_changes_no_other_row(spark):
    from regionloom.operators import neighbours

    nan = float("nan")
    left = [(1, 42.0, -121.0), (2, 42.1, -121.0)]
    right = spark.createDataFrame([(9, 42.1, -121.0), (10, 43.0, -121.0)], "id long, latitude double, longitude double")
    schema = "id long, latitude double, longitude double"
    plain, odd = spark.createDataFrame(left, schema), spark.createDataFrame([*left, (3, nan, -121.0)], schema)
    for f, c in ((lambda d: neighbours.nearest(d, right), "nearest_km"), (lambda d: neighbours.within_counts(d, right, [20.0]), "count_within_20km")):
        a, b = ({r.id: r[c] for r in f(d).collect()} for d in (plain, odd))
        assert {i: b[i] for i in a} == a
        assert b[3] in (None, 0)
    assert neighbours.adjacency_edges(odd, 20.0).count() == neighbours.adjacency_edges(plain, 20.0).count() == 1
    assert neighbours.k_nearest(odd, odd, ["latitude", "longitude"], 1, "id", exclude_same_id=True).count() == 2


def test_cells_beyond_the_bound_of_the_cell_above_are_not_ranked(spark):
    points = spark.range(4000).selectExpr("'' AS g", "id", "rand(5) AS x", "rand(6) AS y", "rand(7) AS z", "1L AS w")
    (points,) = neighbours._prepare(points)
    roots = neighbours._roots(points, points, None)
    free = neighbours._split(roots, points, points, 3, 0)
    near = neighbours._split(roots.withColumn("bound", F.lit(0.01)), points, points, 3, 0)
    assert 0 < near.count() == free.where("gap <= 0.01").count() < free.count()
