import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regionloom.operators import aggregates, correlation, footprints, overlaps, sampling, surfaces


def test_t_quantiles():
    for df, want in ((1, 12.7062), (2, 4.30265), (5, 2.57058), (10, 2.22814), (30, 2.04227), (200, 1.97190), (100000, 1.95998)):
        assert sampling.t_critical_exact(df, 0.95) == pytest.approx(want, rel=2e-4)
    assert sampling.t_critical_exact(10, 0.99) == pytest.approx(3.16927, rel=1e-4)


def test_interval_of_small_tables(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "id int, v double")
    row = sampling.confidence_interval(df, "v").first()
    se = np.std([1, 2, 3, 4], ddof=1) / 2
    assert row["ci_high"] == pytest.approx(2.5 + 4.303 * se, abs=1e-5)  # three degrees of freedom: nearest entry is two
    exact = sampling.confidence_interval(df, "v", t_mode="exact").first()
    assert exact["ci_high"] == pytest.approx(2.5 + 3.182446 * se, abs=1e-4)
    lone = sampling.confidence_interval(df.limit(1), "v").first()
    assert lone["warning"] == "fewer than two values" and lone["estimate"] is None
    assert "population below 30" in sampling.uncertainty(df, "v", "id", 3).first()["warning"]


def test_bootstraps_agree_with_theory(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(10, 3, 400)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "v": values}))
    se = values.std(ddof=1) / math.sqrt(400)
    row = sampling.confidence_interval(df, "v", method="bootstrap", row_id="id", n_bootstrap=400).first()
    assert row["uncertainty"] == pytest.approx(se, rel=0.2)
    assert row["ci_low"] < values.mean() < row["ci_high"]
    small = sampling.bootstrap_ci(df, "v", "id", 400, 400).first()
    assert small["se"] == pytest.approx(se, rel=0.2)


def test_bias_needs_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0), ("b", 4.0)], "k string, v double")
    assert sampling.bias(df, "k", "==", "a", "v").first()["warning"].startswith("a side has fewer")
    row = sampling.bias(df, "k", "!=", "a", "v").first()
    assert row["group_n"] == 3 and row["complement_n"] == 1


def test_regression_p_values(spark):
    x = np.arange(12.0)
    y = 2 + 0.5 * x + np.array([1, -1, 2, -2, 1, 0, -1, 2, -2, 1, -1, 0]) * 0.8
    df = spark.createDataFrame(pd.DataFrame({"year": x, "metric_value": y}))
    row = correlation.regression_summary(df).first()
    t, df_res = row["slope_t"], 10
    u = np.linspace(math.atan(abs(t) / math.sqrt(df_res)), math.pi / 2, 200001)
    whole = np.linspace(0, math.pi / 2, 200001)
    want = np.trapezoid(np.cos(u) ** (df_res - 1), u) / np.trapezoid(np.cos(whole) ** (df_res - 1), whole)
    assert row["slope_p"] == pytest.approx(want, rel=1e-5)
    assert row["r_squared"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)
    assert correlation.regression_summary(df.limit(1)).first()["status"] == "failed"


def test_trend_and_correlation_edges(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("b", 1, 1.0), ("b", 2, 3.0), ("c", None, 1.0)], "k string, x int, y double")
    got = {r["k"]: r["slope"] for r in aggregates.trend(df, "x", "y", ["k"]).collect()}
    assert got == {"a": None, "b": 2.0}
    flat = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 1.0)], "a double, b double, c double")
    pairs = {(r["x"], r["y"]): r["r"] for r in correlation.selected_correlation(flat, ["a", "b", "c"]).collect()}
    assert pairs == {("a", "a"): 1.0, ("a", "b"): None, ("b", "a"): None, ("b", "b"): 1.0}


def test_bayes_without_evidence(spark):
    df = spark.createDataFrame([("x", "y")], "a string, b string")
    assert aggregates.bayes(df, "a", "x", "b", "zzz").first()["bayes"] is None
    assert aggregates.bayes(df, "a", "q", "b", "y").first()["bayes"] == 0.0


def shoelace(p):
    x, y = np.array(p).T
    return abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def test_hulls_hold_their_points(spark):
    rng = np.random.default_rng(5)
    frames = [pd.DataFrame({"k": "cloud", "lon": rng.normal(0, 1, 3000), "lat": rng.normal(0, 1, 3000)}),
              pd.DataFrame({"k": "square", "lon": [0.0, 1, 1, 0, 0.5], "lat": [0.0, 0, 1, 1, 0.5]}),
              pd.DataFrame({"k": "line", "lon": [0.0, 1, 2], "lat": [0.0, 1, 2]}),
              pd.DataFrame({"k": "two", "lon": [0.0, 1.0], "lat": [0.0, 0.0]})]
    df = spark.createDataFrame(pd.concat(frames)).repartition(7)
    got = {r["k"]: [(p["lon"], p["lat"]) for p in r["ring"]] for r in footprints.convex_hull(df, "k").collect()}
    assert set(got["square"]) == {(0, 0), (1, 0), (1, 1), (0, 1)} and len(got["two"]) == 64
    assert shoelace(got["line"]) == 0
    ring = np.array(got["cloud"])
    a, b = ring, np.roll(ring, -1, axis=0)
    for x, y in frames[0][["lon", "lat"]].to_numpy():
        assert ((b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0]) >= -1e-9).all()


def test_overlaps(spark):
    def ring(w, s, e, n):
        return [{"lon": w, "lat": s}, {"lon": e, "lat": s}, {"lon": e, "lat": n}, {"lon": w, "lat": n}]

    tri = [{"lon": 0.0, "lat": 0.0}, {"lon": 2.0, "lat": 0.0}, {"lon": 0.0, "lat": 2.0}]
    hulls = spark.createDataFrame([("a", ring(0.0, 0.0, 1.0, 1.0)), ("b", tri), ("c", ring(5.0, 5.0, 6.0, 6.0))], "source_key string, ring array<struct<lon:double,lat:double>>")
    got = {(r["source_a"], r["source_b"]): r["area_km2"] for r in footprints.footprint_overlap(hulls).collect()}
    assert got == {("a", "b"): pytest.approx(12321.0)}
    ranges = spark.createDataFrame([("a", "2020-01-01", "2020-02-01"), ("c", "2020-01-31", "2020-03-01"), ("z", "2020-01-01", "2020-02-01")], "source_key string, s string, e string")
    ranges = ranges.select("source_key", F.to_timestamp("s").alias("time_start"), F.to_timestamp("e").alias("time_end"))
    rows = {(r["source_a"], r["source_b"]): r for r in footprints.spacetime_overlap(hulls, ranges).collect()}
    assert set(rows) == {("a", "b"), ("a", "c")}
    assert rows[("a", "c")]["geometry"] is None and rows[("a", "c")]["overlap_days"] == 1 and rows[("a", "c")]["time_start"] == "2020-01-31"
    assert footprints.layer_relationships(footprints.spacetime_overlap(hulls, ranges)).count() == 2


def test_points_in_polygons_of_all_sizes(spark):
    rng = np.random.default_rng(2)
    centres = np.column_stack([rng.uniform(-170, 170, 30), rng.uniform(-80, 80, 30)])
    sizes = 10.0 ** rng.uniform(-2, 1.2, 30)
    polygons = [(i, [{"lon": float(x + s * dx), "lat": float(y + s * dy)} for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1))]) for i, ((x, y), s) in enumerate(zip(centres, sizes))]
    points = np.vstack([np.column_stack([rng.uniform(-180, 180, 2000), rng.uniform(-90, 90, 2000)]), centres + rng.normal(0, 0.02, centres.shape)])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(points)), "longitude": points[:, 0], "latitude": points[:, 1]}))
    polys = spark.createDataFrame(polygons, "pid int, ring array<struct<lon:double,lat:double>>")
    got = {(r["id"], r["pid"]) for r in footprints.spatial_join(df, polys, "pid").collect()}
    d = np.abs(points[:, None, 0] - centres[None, :, 0]) + np.abs(points[:, None, 1] - centres[None, :, 1])
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d < sizes[None, :]))}
    assert footprints.polygon_filter(df, polys, "pid", "id").count() == len({i for i, _ in got})


def test_interpolation_returns_values_at_hits(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 1.0, 2.0), (1.0, 0.0, 3.0), (1.0, 1.0, None), (1.0, 1.0, 6.0), (1.0, 1.0, 4.0)], "latitude double, longitude double, metric_value double")
    got = {(r["row"], r["col"]): r["estimate"] for r in surfaces.spatial_interpolation(df, 3).collect()}
    assert got[(0, 0)] == 1.0 and got[(2, 2)] == 5.0 and got[(1, 1)] == pytest.approx((1 + 2 + 3 + 10) / 5)


def test_nan_is_missing_everywhere(spark):
    from regionloom.operators import aggregates
    from regionloom.operators.quantiles import exact_quantiles

    nan = float("nan")
    rows = [("a", "x", 2020, 1.0, 42.0, -121.0), ("a", "x", 2020, nan, nan, -121.0), ("a", "y", 2021, 3.0, 42.1, nan), ("b", "y", 2021, None, 42.2, -121.2)]
    obs = spark.createDataFrame(rows, "source_key string, county string, year int, metric_value double, latitude double, longitude double")
    county = {r.county: (r.metric_sum, r.metric_mean) for r in aggregates.county_compare(obs).collect()}
    assert county == {"x": (1.0, 1.0), "y": (3.0, 3.0)}
    plain = {r.source_key: r for r in aggregates.aggregate_source(obs, ["source_key"]).collect()}
    assert (plain["a"].metric_value_count, plain["a"].metric_value_mean, plain["a"].metric_value_max) == (2, 2.0, 3.0)
    assert exact_quantiles(obs, "metric_value", [0.5]).first()["value"] == 2.0
    assert {r.stat: r.distance_km for r in aggregates.distance_stats(obs.withColumnRenamed("metric_value", "distance_km")).collect()}["median"] == 2.0
    place = aggregates.spatial_summary(obs).first()
    assert (place.north, place.east, place.null_share) == (42.2, -121.0, 0.5)


def test_kmeans_does_not_depend_on_partitions(spark):
    from regionloom.models.clustering import kmeans

    rows = spark.range(600).selectExpr("id", "(id * 7919 % 1000) / 10.0 AS x", "(id * 104729 % 777) / 7.0 AS y")
    found = [kmeans(rows.repartition(n), ["x", "y"], 4) for n in (1, 3, 8)]
    assert found[0].centers == found[1].centers == found[2].centers and found[0].iterations > 1
    assert abs(found[0].inertia - found[2].inertia) < 1e-6


def test_weighted_centers_do_not_hang_on_last_digits():
    """Points of a grid are as far from one centre as from another."""
    from regionloom.models.clustering import weighted_centers

    grid = np.array([(a, b) for a in range(12) for b in range(12)], float)
    grid = (grid - grid.mean(axis=0)) / grid.std(axis=0)
    want = weighted_centers(grid, np.ones(144), 6, 42)
    for s in (1, -1, 2, -2, 3):
        assert np.abs(weighted_centers(grid * (1 + s * 2.3e-16) + s * 1e-16, np.ones(144), 6, 42) - want).max() < 1e-9


def test_no_table_and_no_pair(spark):
    from regionloom.operators import aggregates, correlation

    assert aggregates.time_ranges({}, {}).count() == aggregates.load_report({}, (0, 0), 1.0).count() == 0
    one = spark.range(9).selectExpr("id", "id * 1.5 AS v")
    assert correlation.cross_source_correlation({}, "v", "id").count() == correlation.cross_source_correlation({"a": one}, "v", "id").count() == 0
    assert correlation.cross_source_correlation({"a": one, "b": one}, "v", "id").first()["r"] > 0.999


def test_staging_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    import pytest

    from regionloom.session import staging_folder

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: conf, master="yarn", applicationId="app")
    with pytest.raises(RuntimeError):
        staging_folder(SimpleNamespace(sparkContext=context, conf=conf))


def test_little_bootstraps_cover_the_mean_as_often_as_they_say():
    """Four hundred tables: the intervals of one subset of n ** 0.6 rows each, moved to the table's mean."""
    random = np.random.default_rng(12)
    n, size, covered, ses = 2000, 96, 0, []
    for _ in range(400):
        values = random.exponential(1.0, n)
        subset = values[:size]
        means = sampling.resampled_means(subset, n, 100, random)
        low, high = sampling.interval_ends(means, 0.95)
        covered += values.mean() + low - subset.mean() <= 1.0 <= values.mean() + high - subset.mean()
        ses.append(means.std(ddof=1))
    assert 0.90 <= covered / 400 <= 0.98
    assert np.mean(ses) == pytest.approx(1 / np.sqrt(n), rel=0.05)


def test_bootstraps_of_whole_tables_agree_with_theory(spark):
    random = np.random.default_rng(13)
    values = random.exponential(2.0, 30_000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
    theory = values.std(ddof=1) / np.sqrt(len(values))
    for method in ("bootstrap", "little_bootstraps"):
        row = sampling.confidence_interval(df, "v", method=method, row_id="id", n_bootstrap=500).first()
        assert row["uncertainty"] == pytest.approx(theory, rel=0.1), method
        assert row["estimate"] == pytest.approx(values.mean(), abs=1e-6)
        assert row["ci_low"] == pytest.approx(values.mean() - 1.96 * theory, abs=0.35 * theory)
        assert row["ci_high"] == pytest.approx(values.mean() + 1.96 * theory, abs=0.35 * theory)
    bag = sampling.little_bootstraps(df, "v", "id").collect()
    assert len(bag) == 20 and all(300 < r["size"] < 700 for r in bag)


def test_little_bootstraps_of_small_and_empty_tables(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)] + [(9, None)], "id long, v double")
    (row,) = sampling.little_bootstraps(df, "v", "id").collect()
    assert row["size"] <= 5 and row["subset"] == 0
    assert sampling.little_bootstraps(df.limit(0), "v", "id").collect() == []
    empty = sampling.confidence_interval(df.limit(0), "v", method="little_bootstraps", row_id="id").first()
    assert empty["sample_size"] == 0 and empty["warning"]


def test_meeting_pairs_are_those_of_all_comparisons(spark):
    """Boxes of all sizes, copies, points, touching borders, odd ends; no nested loop in the plan."""
    random = np.random.default_rng(14)
    low = np.round(random.uniform(-50, 50, (160, 2)), 1)
    side = np.round(np.exp(random.uniform(-6, 4, (160, 2))), 1)
    low[:20], side[:20] = low[20], side[20]
    side[30:40] = 0
    rows = [(i, float(a), float(a + c), float(b), float(b + d)) for i, ((a, b), (c, d)) in enumerate(zip(low, side, strict=True))]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4]}
    odd = [(900, None, 1.0, 0.0, 1.0), (901, 0.0, float("nan"), 0.0, 1.0), (902, 5.0, -5.0, 0.0, 1.0), (None, -50.0, 50.0, -50.0, 50.0)]
    df = spark.createDataFrame(rows + odd, "id long, w double, e double, s double, n double")
    pairs = overlaps.meeting_pairs(df, "id", [(F.col("w"), F.col("e")), (F.col("s"), F.col("n"))])
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    line = [(r["a"], r["b"]) for r in overlaps.meeting_pairs(df, "id", [(F.col("w"), F.col("e"))]).collect()]
    assert sorted(line) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2])
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert overlaps.meeting_pairs(df.limit(0), "id", [(F.col("w"), F.col("e"))]).collect() == []


def test_risk_within_its_error_bound(spark):
    """The cut-off leaves out no more than the bound says, and fewer rows meet as the bandwidth falls."""
    random = np.random.default_rng(15)
    rows = [(float(a), float(b), float(v)) for a, b, v in zip(random.uniform(40, 42, 300), random.uniform(-3, -1, 300), random.normal(0, 5, 300), strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, 2.0), (41.0, -2.0, None)], "latitude double, longitude double, v double")
    points = np.array(rows)
    size = np.abs(points[:, 2]).sum()
    for bandwidth, tolerance in ((0.03, 1e-13), (0.03, 1e-3), (0.5, 1e-13)):
        got = {(r["row"], r["col"]): r for r in surfaces.risk_surface(df, bandwidth, 9, "v", tolerance=tolerance).collect()}
        assert len(got) == 81
        for r in got.values():
            square = (points[:, 0] - r["grid_lat"]) ** 2 + (points[:, 1] - r["grid_lon"]) ** 2
            assert abs(r["risk"] - (points[:, 2] * np.exp(-square / (2 * bandwidth**2))).sum()) <= (tolerance + 1e-12) * size
    assert surfaces.cut_off(0.03, 1e-13) < 0.25
    one = surfaces.risk_surface(df.limit(1), 0.1, 3, "v").collect()
    assert len(one) == 9 and len({round(r["risk"], 9) for r in one}) == 1
    assert surfaces.risk_surface(df.limit(0), 0.1, 3, "v").collect() == []


def even_odd(ring, x, y):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            inside = not inside
    return inside


def test_points_in_large_rings_with_holes(spark):
    random = np.random.default_rng(16)

    def star(cx, cy, r, n):
        t = 2 * np.pi * np.arange(n) / n
        far = r * (1 + 0.5 * np.sin(11 * t))
        return [(float(cx + f * np.cos(a)), float(cy + f * np.sin(a))) for f, a in zip(far, t, strict=True)]

    comb = [(float(i) / 20, 5.0 if i % 2 else 0.0) for i in range(200)] + [(10.0, -1.0), (0.0, -1.0)]  # tall edges
    rings = {1: (star(0, 0, 3, 700), [star(0.5, 0, 0.5, 90), star(-1, 0, 0.2, 5)]), 2: (star(2, 2, 1, 10), []), 3: (comb, None), 4: (star(-3, 1, 2, 65), [])}
    shape = "array<struct<lon:double,lat:double>>"
    polys = spark.createDataFrame([(i, r, h) for i, (r, h) in rings.items()], f"pid int, ring {shape}, holes array<{shape}>")
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(random.uniform(-5, 10, (600, 2)))] + [(900, None, 1.0), (901, 0.0, None)]
    df = spark.createDataFrame(points, "id int, longitude double, latitude double")
    got = [(r["id"], r["pid"]) for r in footprints.spatial_join(df, polys, "pid", holes="holes").collect()]
    want = {
        (i, k)
        for i, x, y in points
        if x is not None and y is not None
        for k, (ring, holes) in rings.items()
        if even_odd(ring, x, y) and not any(even_odd(h, x, y) for h in holes or [])
    }
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_a_ring_of_a_hundred_thousand_edges(spark):
    t = 2 * np.pi * np.arange(100_000) / 100_000
    ring = [(float(np.cos(a)), float(np.sin(a))) for a in t]
    polys = spark.createDataFrame([(1, ring)], "pid int, ring array<struct<lon:double,lat:double>>")
    points = spark.range(20_000).selectExpr("id", "(id % 200) / 100D - 0.995D AS longitude", "floor(id / 200) / 50D - 0.99D AS latitude")
    inside = footprints.spatial_join(points, polys, "pid")
    want = points.where("longitude * longitude + latitude * latitude < 1").count()
    assert abs(inside.count() - want) <= 4


def test_poisson_bootstrap_weighs_every_row(spark):
    import hashlib

    from regionloom.operators import sampling

    ends = sampling.poisson_weights()
    values = {i: None if i == 7 else i * 1.25 for i in range(40)}
    df = spark.createDataFrame(list(values.items()), "id long, v double")
    found = {r.rep: r.m for r in sampling.poisson_bootstrap_means(df, "v", "id", n_iter=25).collect()}
    for rep in range(25):
        draws = {i: int(hashlib.md5(f"{i}:{rep}:42".encode()).hexdigest()[:8], 16) / 2**32 for i in values}
        weights = {i: sum(u >= end for end in ends) for i, u in draws.items() if values[i] is not None}
        assert abs(found[rep] - sum(w * values[i] for i, w in weights.items()) / sum(weights.values())) < 1e-9


def test_overlaps_are_added_up_without_pairs(spark, monkeypatch):
    """Totals of later rows over several blocks and spans, with copies, points and odd ends, against all pairs."""
    random = np.random.default_rng(16)
    start = random.integers(-40, 400, 700)
    start[:120] = 77
    length = random.integers(0, 30, 700)
    rows = [(int(i), int(a), int(a + n)) for i, (a, n) in enumerate(zip(start, length, strict=True))]
    monkeypatch.setattr(overlaps, "BLOCK_ROWS", 64)
    made = []
    monkeypatch.setattr(footprints, "time_overlap", lambda *a: made.append(a))
    days = spark.createDataFrame(rows + [(900, None, 5), (901, 9, 3)], "k long, a int, z int")
    hour = 3_600_000_000
    df = days.select("k", *[F.timestamp_micros(F.col(c).cast("long") * (24 * hour) + 7 * hour).alias(n) for c, n in (("a", "time_start"), ("z", "time_end"))])
    want = {}
    for k, a, z in rows:
        shared = [min(z, y) - max(a, b) for j, b, y in rows if j > k and a <= y and b <= z]
        if shared:
            want[k] = (len(shared), sum(shared))
    got = footprints.time_overlap_totals(df, "k").collect()
    assert {r["source_a"]: (r["n_later"], r["overlap_days"]) for r in got} == want and len(got) == len(want) and not made


def test_overlaps_at_odd_hours_are_added_up(spark):
    df = spark.createDataFrame([(1, 0, 100), (2, 30, 90), (3, 95, 200)], "k long, a int, z int")
    df = df.select("k", *[F.timestamp_micros(F.col(c).cast("long") * 3_600_000_000).alias(n) for c, n in (("a", "time_start"), ("z", "time_end"))])
    assert [tuple(r) for r in footprints.time_overlap_totals(df, "k").collect()] == [(1, 2, 2)]
    assert footprints.time_overlap_totals(df.limit(0), "k").collect() == []
