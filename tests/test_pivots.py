"""k nearest neighbours over any number of features, against brute force."""

import numpy as np
import pytest

from regionloom.operators import boxes, neighbours, pivots


def brute_force(left, right, k, exclude):
    out = {}
    for i, x in enumerate(left):
        d = np.sqrt(((right - x) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(d)), d)) if not (exclude and j == i)][:k]
        out[i] = [(int(j), float(d[j])) for j in order]
    return out


def search(spark, left, right, k, exclude=False):
    def table(points):
        return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(points)], "id long, v array<double>")

    a = table(left)
    found = pivots.nearest_vectors(a, a if exclude else table(right), "v", k, "id", exclude).collect()
    out = {i: [] for i in range(len(left))}
    for r in sorted(found, key=lambda r: (r["id"], r["rank"])):
        assert r["rank"] == len(out[r["id"]]) + 1
        out[r["id"]].append((r["neighbour_id"], r["distance"]))
    return out


def same(got, want):
    assert {i: [x for x, _ in v] for i, v in got.items()} == {i: [x for x, _ in v] for i, v in want.items()}
    for i in want:
        assert [d for _, d in got[i]] == pytest.approx([d for _, d in want[i]], rel=1e-9, abs=1e-9)


@pytest.fixture
def small_parts(monkeypatch):
    """Groups, rings and bundles so small that all of them are used."""
    for name, value in (("GROUP_ROWS", 100), ("RING_ROWS", 40), ("BUNDLE_ROWS", 150), ("MOST_PIVOTS", 12)):
        monkeypatch.setattr(pivots, name, value)


def test_many_features(spark):
    x = np.random.default_rng(1).standard_normal((700, 40))
    same(search(spark, x, x, 5, True), brute_force(x, x, 5, True))


def test_crowded_cells_far_from_the_origin(spark, small_parts):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 5)) * 10
    blobs = centres[rng.integers(0, 6, 500)] + 0.3 * rng.standard_normal((500, 5))
    copies = np.tile(centres[0], (250, 1))  # a third of all rows at one place
    grid = np.round(rng.standard_normal((150, 5)))  # ties
    x = np.concatenate([blobs, copies, grid]) + 1e6
    same(search(spark, x, x, 4, True), brute_force(x, x, 4, True))
    same(search(spark, x[::3], x[1::2], 7), brute_force(x[::3], x[1::2], 7, False))


def test_cells_out_of_reach_are_not_sent(spark, small_parts, monkeypatch):
    """Tight blobs: a group meets its own rings and few others, not all rows."""
    met = []
    compared = pivots._compared

    def counted(pairs, spots, rights, need, shift):
        met.append(pairs.selectExpr("sum(n)").first()[0])
        return compared(pairs, spots, rights, need, shift)

    monkeypatch.setattr(pivots, "_compared", counted)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((12, 6)) * 100, 100, axis=0) + rng.standard_normal((1200, 6))
    same(search(spark, x, x, 3, True), brute_force(x, x, 3, True))
    assert sum(met) < 0.4 * 1200 * 12  # twelve groups of a hundred


def test_fewer_rows_than_neighbours(spark, small_parts):
    x = np.random.default_rng(4).standard_normal((50, 4))
    same(search(spark, x, x[:3], 5), brute_force(x, x[:3], 5, False))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted(tuple(r) for r in pivots.nearest_vectors(df, df, "v", 2, "id", True).collect())
    assert {r[0] for r in got} == {1, 2} and (1, 2, 5.0, 1) in got and (2, 1, 5.0, 1) in got
    assert pivots.nearest_vectors(df, df.limit(0), "v", 2).collect() == []
    assert pivots.nearest_vectors(df.limit(0), df, "v", 2).collect() == []


def test_operators_take_more_than_three_features(spark):
    x = np.random.default_rng(5).standard_normal((80, 5))
    names = list("abcde")
    df = spark.createDataFrame([(i, *map(float, v), i % 2) for i, v in enumerate(x)], "id long, a double, b double, c double, d double, e double, y int")
    want = brute_force(x, x, 2, True)
    got = neighbours.k_nearest(df, df, names, 2, "id", exclude_same_id=True).collect()
    assert {(r["id"], r["neighbour_id"]) for r in got} == {(i, j) for i, v in want.items() for j, _ in v}
    assert neighbours.knn_graph(df, names, 2, "id").count() == 160
    predicted = dict(neighbours.knn_predict(df, df, names, "y", 1, "id").collect())
    assert predicted == {i: i % 2 for i in range(80)}


def test_copies_of_a_place_are_limited_before_they_travel(spark, tmp_path):
    """The row number over the copies of a place is limited in each task: a hot place is no single task."""
    from pyspark.sql import Window, functions as F

    df = spark.range(100).selectExpr("array(double(id % 2)) AS v", "id")
    limited = df.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where("r <= 3")
    assert "WindowGroupLimit" in limited._jdf.queryExecution().executedPlan().toString()


def test_few_features_meet_few_cells_at_any_size(spark, monkeypatch):
    """The cells that a point asks do not grow with the table."""
    asked, compared = [], boxes._compared

    def counted(lefts, rights, need):
        asked.append(lefts.count())
        return compared(lefts, rights, need)

    monkeypatch.setattr(boxes, "CELL_ROWS", 150)
    monkeypatch.setattr(boxes, "_compared", counted)
    for n in (1500, 6000):
        x = np.random.default_rng(n).random((n, 4))
        same(search(spark, x, x, 3, True), brute_force(x, x, 3, True))
        assert asked[-2] == n and asked[-1] < 8 * n


def test_boxes_of_copies_ties_and_strangers(spark, monkeypatch):
    monkeypatch.setattr(boxes, "CELL_ROWS", 60)
    rng = np.random.default_rng(8)
    copies = np.tile([0.0, 0.0, 0.0, 1.0, 0.0], (200, 1))
    grid = rng.integers(0, 3, (400, 5)).astype(float)
    line = np.outer(np.arange(200), [1e5, 0, 0, 0, 0])
    right = np.concatenate([copies, grid, line, rng.standard_normal((300, 5))]) - 1e6
    left = np.concatenate([right[::3], 1e6 * rng.standard_normal((150, 5))])
    same(search(spark, left, right, 20), brute_force(left, right, 20, False))
    same(search(spark, right, right, 4, True), brute_force(right, right, 4, True))
