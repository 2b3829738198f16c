import math

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from regionloom.functions import geo, scalars
from regionloom.operators import bins, columns, filters, joins, positions, profiling, quantiles, tables


@pytest.fixture(scope="module")
def debug(spark):
    rows = [("alpha", 10, "a", 42.1, -121.1), ("beta", 20, "b", 42.2, -121.2), ("gamma", 30, "a", 42.3, -121.3)]
    return spark.createDataFrame(rows, "name string, value int, category string, latitude double, longitude double")


def test_fixture_source(spark, debug):
    assert [r[0] for r in columns.add_column(debug, "twice", "debug[value] * 2").select("twice").orderBy("twice").collect()] == [20, 40, 60]
    assert columns.add_column(debug, "m", "mean(debug[value]) * 2.5D", {"debug": debug}).select("m").distinct().collect()[0][0] == 50.0
    sliced = positions.index(debug, "0..2", "name,value", "value")
    assert [tuple(r) for r in sliced.orderBy("__row_id__").collect()] == [(0, "alpha", 10), (1, "beta", 20)]
    more = tables.add_rows(debug, [("delta", 40, "c", 42.4, -121.4)])
    assert more.count() == 4
    first = spark.createDataFrame([("alpha", 1), ("beta", 2)], "name string, value int")
    second = spark.createDataFrame([("gamma", 5), ("delta", 8)], "name string, score int")
    fused = tables.fuse({"first": first, "second": second})
    assert fused.columns.count("__source__") == 1 and set(fused.columns) == {"name", "value", "score", "__source__"}
    assert fused.where("score IS NULL").count() == 2


def test_index_list_and_remove(debug):
    picked = positions.index(debug, [2, 0], "name", "value").orderBy("__row_id__")
    assert [tuple(r) for r in picked.collect()] == [(0, "gamma"), (1, "alpha")]
    assert positions.index(debug, "all", "zzz", "value").columns == ["__row_id__", *debug.columns]
    assert [r[0] for r in positions.remove_rows(debug, "0..1", "value").select("name").orderBy("name").collect()] == ["beta", "gamma"]


def test_positions_over_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, (i * 7919) % 1009) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = positions.number_rows(df, ["v", "i"], by=["k"], name="p").toPandas()
    want = pd.DataFrame(rows, columns=["k", "i", "v"]).sort_values(["k", "v", "i"])
    want["p"] = want.groupby("k").cumcount()
    merged = got.merge(want, on=["k", "i"])
    assert len(merged) == 3000 and (merged["p_x"] == merged["p_y"]).all()
    whole = positions.number_rows(df, ["v", "i"]).orderBy("__row_id__").toPandas()
    assert whole["__row_id__"].tolist() == list(range(3000))
    assert whole["i"].tolist() == want.sort_values(["v", "i"])["i"].tolist()


def test_append_pads_and_truncates(spark, debug):
    short = spark.createDataFrame([(1, 1.5)], "o int, x double")
    got = positions.append_column(debug, short, "x", "new", "value", "o").orderBy("value").select("new").collect()
    assert [r[0] for r in got] == [1.5, None, None]
    assert positions.align_by_position(debug.select("value"), short, "value", "o").count() == 1


def test_names_roles_and_subset(debug):
    named = columns.name_columns(debug, {"name": "title", "value": "latitude"})
    assert named.columns[0] == "title" and columns.role_of(named, "value") == "latitude"
    assert columns.subset({"d": debug}, {"d": ["value", "nope"], "x": ["y"]})["d"].columns == ["value"]


def test_unknown_symbol_is_an_error(debug):
    with pytest.raises(Exception):
        columns.derive(debug, "x", "no_such + 1").collect()


def test_conditions_and_commands(debug):
    changed = columns.set_if(debug, "value > 15", "category", "z").orderBy("value")
    assert [r["category"] for r in changed.collect()] == ["a", "z", "z"]
    steps = [{"type": "filter", "predicate": "value > 10"}, {"type": "rename", "mapping": {"value": "v"}}, {"type": "type_cast", "types": {"v": "double"}}]
    assert columns.run_commands(debug, steps, preview=1).columns[1] == "v"


def test_radius_texts_and_boxes(spark):
    assert filters.parse_radius("50mi") == pytest.approx(80.467, abs=1e-2)
    assert filters.parse_radius("200km") == 200.0
    with pytest.raises(ValueError):
        filters.parse_radius("far")
    points = [(0, 0.0, 179.95), (1, 0.0, -179.95), (2, 89.9, 10.0), (3, 89.9, -170.0), (4, None, 1.0)]
    df = spark.createDataFrame(points, "id int, latitude double, longitude double")
    assert {r["id"] for r in filters.near(df, (0.0, 180.0), 20).collect()} == {0, 1}
    assert {r["id"] for r in filters.near(df, (90.0, 0.0), "20km").collect()} == {2, 3}
    assert filters.near(df.drop("latitude"), (0, 0), 1).count() == 5


def test_near_reaches_the_scan(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id / 10.0D AS latitude", "id / 10.0D AS longitude")
    path = str(tmp_path / "points")
    df.write.parquet(path)
    plan = filters.near(spark.read.parquet(path), (5.0, 5.0), 30)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(latitude)" in plan and "GreaterThanOrEqual(latitude" in plan


def test_scalars(spark):
    texts = ["1-2", "-1.5", "1.2.3", "$5", " 7 ", "", None, "NaN", "abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", scalars.looks_numeric("t").alias("l"), scalars.to_numeric("t").alias("n"), scalars.currency("t").alias("c")).orderBy("i").collect()
    assert [r["l"] for r in got] == [True, True, False, False, False, False, None, False, False]
    assert [r["n"] for r in got] == [None, -1.5, None, None, 7.0, None, None, None, None]
    assert got[3]["c"] == 5.0
    times = ["2020-08-01", "08/03/2020", "20210719", "2021-09-02 10:20:30", "2021/01/02", "soon", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(F.date_format(scalars.to_time("t"), "yyyyMMddHHmm")).collect()]
    assert got == ["202008010000", "202008030000", "202107190000", "202109021020", "202101020000", None, None]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in halves.select(scalars.round_half_even("x", 0)).collect()] == [0.0, 2.0, 2.0]
    p = spark.createDataFrame([([0.25, 0.75],)], "p array<double>").select(scalars.entropy("p")).first()[0]
    assert p == pytest.approx(-sum(v * math.log(v + 1e-9) for v in (0.25, 0.75)))
    with pytest.raises(ValueError):
        scalars.convert_unit("x", "ft", "m2")


def test_first_present_and_normalize(spark):
    df = spark.createDataFrame([("", "2021.0", "42.5", "-121.5", "x"), ("Lake", None, "bad", None, "3")], "COUNTY string, fireyear string, lat_dd string, long_dd string, value string")
    rows = columns.normalize_observations(df, "some_fires", (42.5, -121.5)).collect()
    assert [(r["county"], r["year"], r["latitude"], r["metric_value"]) for r in rows] == [(None, 2021, 42.5, None), ("Lake", None, None, 3.0)]
    assert rows[0]["source_label"] == "Some Fires" and rows[0]["distance_km"] == 0.0 and rows[1]["distance_km"] is None


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 10.0], [5.0, 5.0], [0.0, 0.0], [-3.0, -3.0], [0.0123, 0.5, 0.99], [0.01, 0.02, 0.05, 0.1], [100.5, 2000.25, 3000.125, 4999.0, 7.0]])
def test_bins_are_those_of_pandas(spark, values):
    df = spark.createDataFrame([("s", v) for v in values], "source_key string, x double")
    got = bins.frequency_bins(df, ["x", "absent"], 5).orderBy("bin").collect()
    series = pd.Series(values)
    counts = pd.cut(series, bins=min(5, series.nunique()), duplicates="drop").value_counts(sort=False)
    assert [(r["bin_low"], r["bin_high"], r["count"]) for r in got] == [(i.left, i.right, c) for i, c in counts.items()]
    assert [r["bin_label"] for r in got] == [f"{i.left:.2f} to {i.right:.2f}" for i in counts.index]
    labelled = bins.distribution_bin(df, "x", 5)
    assert labelled.where("bin_label IS NULL").count() == 0 and labelled.count() == len(values)


def test_quantiles_with_hot_value(spark):
    rows = [("a", float(i % 5 if i % 3 else 2)) for i in range(900)] + [("b", 1.0), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["q"]): r["value"] for r in quantiles.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.99, 1.0], by=["k"]).collect()}
    a = pd.Series([v for k, v in rows if k == "a"])
    for q in (0.0, 0.25, 0.5, 0.99, 1.0):
        assert got[("a", q)] == pytest.approx(a.quantile(q))
        assert got[("b", q)] == 1.0
    assert not any(k == "c" for k, _ in got)


def test_normalize_constant_and_empty(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 2.0), (3, None, 3.0)], "id int, flat double, x double")
    got = columns.normalize(df, ["flat", "x"]).orderBy("id").collect()
    assert [r["flat"] for r in got] == [0.0, 0.0, None]
    assert got[2]["x"] == pytest.approx(1.224744871)
    assert columns.normalize(df.limit(0), ["x"], "minmax").count() == 0


def test_feature_columns(spark):
    df = spark.createDataFrame([(1.0, "2020-01-01", "q", None), (float("nan"), "2020-01-02", "q", None)], "a double, d string, t string, e double")
    usable = columns.feature_columns(df, ["a", "d", "t", "e", "zz"])
    assert list(usable) == ["a", "d"]
    assert columns.feature_matrix(df, ["a", "d", "t", "e"]).count() == 1
    assert columns.drop_constant(df, ["a", "e"]).columns == ["d", "t"]


def test_describe_and_centroids(spark):
    profile = spark.createDataFrame([("GACC",), ("x",), ("y",)], "name string")
    words = spark.createDataFrame([("x", "An x")], "field_name string, description string")
    got = dict(joins.describe_columns(profile, words, {"GACC": "Area"}).collect())
    assert got == {"GACC": "Area", "x": "An x", "y": ""}


def test_profile_rules(spark):
    rows = [(i, 42.0 + i / 1000, 500.0 + i, f"${i}", "x" if i % 2 else "", float("nan") if i else 1.0, "2020-01-01", f"c{i % 3}") for i in range(100)]
    df = spark.createDataFrame(rows, "fid int, lat double, plateau double, paid string, note string, depth double, report_date string, kind string")
    got = {r["name"]: (r["inferred_type"], r["inferred_unit_tag"], r["null_count"], r["unique_values"]) for r in profiling.profile(df).collect()}
    assert got["fid"] == ("numeric", "unique_identifier", 0, 100)
    assert got["lat"] == ("float", "decimal_degrees", 0, 100)
    assert got["plateau"] == ("numeric", None, 0, 100)
    assert got["paid"] == ("currency", "USD", 0, 100)
    assert got["note"] == ("categorical", "label_lookup", 50, 1)
    assert got["depth"] == ("numeric", "depth", 99, 1)
    assert got["report_date"] == ("datetime", "temporal", 0, 1)
    assert got["kind"] == ("categorical", "label_lookup", 0, 3)
    assert profiling.profile(df.limit(0)).count() == 8
    assert profiling.profile(df, exact=False).count() == 8


def test_type_similarity(spark):
    a = spark.createDataFrame([(1, 42.0), (2, 43.0)], "fire_id int, lat double")
    b = spark.createDataFrame([(7, 44.0), (8, 45.0)], "slide_id int, latitude double")
    got = {(r["name_a"], r["name_b"]) for r in profiling.type_similarity({"a": a, "b": b}).collect()}
    assert got == {("fire_id", "slide_id"), ("lat", "latitude")}


def test_rings(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    df = spark.createDataFrame([([{"lon": x, "lat": y} for x, y in square],), ([{"lon": 1.0, "lat": 1.0}],), ([],)], "ring array<struct<lon:double,lat:double>>")
    assert [r[0] for r in df.select(geo.ring_area("ring")).collect()] == [4.0, 0.0, 0.0]
    assert [r[0] for r in df.limit(1).select(geo.ring_contains("ring", F.lit(1.0), F.lit(1.5)), geo.ring_contains("ring", F.lit(3.0), F.lit(1.5))).collect()[0:1]] == [True]
    aware = df.limit(1).select(geo.ring_area_km2("ring", True)).first()[0]
    assert aware == pytest.approx(4 * 111**2 * math.cos(math.radians(1)))


def test_row_functions_apply_to_streams(spark, tmp_path):
    """Row-local operators are plain expressions, so a streaming table takes them as well."""
    path = str(tmp_path / "in")
    spark.range(50).selectExpr("id", "42 + id / 100.0D AS latitude", "-121.5D AS longitude").write.parquet(path)
    stream = spark.readStream.schema("id long, latitude double, longitude double").parquet(path)
    near = filters.near(stream, (42.0, -121.5), 11.2)
    sink = near.writeStream.format("memory").queryName("near_points").trigger(availableNow=True).start()
    sink.awaitTermination(60)
    assert spark.table("near_points").count() == filters.near(spark.read.parquet(path), (42.0, -121.5), 11.2).count() > 0


def test_profiles_of_parts_add_up(spark, tmp_path):
    """The profile of old and new data together is that of all of it, within the stated errors; states survive a file."""
    rows = [(i, f"name{i % 700}" if i % 5 else "", float(i % 997) / 7 if i % 11 else float("nan"), f"${i % 30}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, name string, depth_km double, price string")
    old, new = df.where("id < 13000"), df.where("id >= 13000")
    profiling.profile_state(old).write.parquet(str(tmp_path / "old"))
    merged = profiling.merge_states([spark.read.parquet(str(tmp_path / "old")), profiling.profile_state(new)])
    both = {r["name"]: r for r in profiling.profile_of_state(merged).collect()}
    whole = {r["name"]: r for r in profiling.profile_of_state(profiling.profile_state(df)).collect()}
    exact = {r["name"]: r for r in profiling.profile(df).collect()}
    values = {"id": range(20_000), "depth_km": [r[2] for r in rows if r[2] == r[2]]}
    for name, r in both.items():
        for c in ("position", "n", "null_count", "low", "high", "inferred_type", "inferred_unit_tag"):
            assert r[c] == whole[name][c]
        for c in ("null_count", "inferred_type", "inferred_unit_tag"):
            assert r[c] == exact[name][c]
        assert abs(r["unique_values"] / exact[name]["unique_values"] - 1) <= profiling.DISTINCT_ERROR
        if name in values:
            for q in (25, 50, 75):
                rank = sum(v <= r[f"q{q}"] for v in values[name]) / len(values[name])
                assert abs(rank - q / 100) <= 2 * profiling.QUANTILE_ERROR
    empty = profiling.profile_of_state(profiling.merge_states([profiling.profile_state(df.limit(0))])).collect()
    assert len(empty) == 4 and all(r["n"] == 0 and r["unique_values"] == 0 and r["q50"] is None for r in empty)


def test_rings_by_batches_agree_with_ray_casting(spark):
    """Stars, short, empty and missing rings; no function on arrays in the plan."""
    random = np.random.default_rng(21)
    rings = [[{"lon": float(a * math.cos(t)), "lat": float(a * math.sin(t))} for a, t in zip(random.uniform(0.2, 2, n), np.linspace(0, 6.2, n))] for n in (3, 4, 9, 64, 200) for _ in range(12)]
    rows = [(i, r, float(random.uniform(-1, 1)), float(random.uniform(-1, 1))) for i, r in enumerate([*rings, [], None, rings[0][:1], rings[0][:2]])]
    df = spark.createDataFrame(rows, "id int, ring array<struct<lon:double,lat:double>>, x double, y double").repartition(3)
    got = df.select("ring", geo.ring_area("ring").alias("area"), geo.rings_contain("ring", "x", "y").alias("a"), geo.ring_contains("ring", F.col("x"), F.col("y")).alias("b"))
    for r in got.collect():
        assert r.a == r.b
        corners = [(p.lon, p.lat) for p in r.ring or []]
        plain = abs(sum(a * d - c * b for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1]))) / 2
        assert (r.area is None) == (r.ring is None) and (r.ring is None or r.area == pytest.approx(plain if len(corners) > 2 else 0.0))
    plan = df.select(geo.ring_area("ring"), geo.rings_contain("ring", "x", "y"))._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan


def test_profiles_count_distinct_values_by_bounded_tasks(spark, monkeypatch):
    """Types of all kinds, signed zeros, NaN, missing and frequent values over many tasks, beside Spark's own distinct counts."""
    import datetime

    rows = [
        (i, i % 7 if i % 3 else None, [0.0, -0.0, float("nan"), 2.5, None][i % 5], str(i % 11) if i % 4 else "", datetime.date(2020, 1, 1 + i % 9), datetime.datetime(2020, 1, 1, i % 24), bool(i % 2), [i % 3, None], {"a": i % 5}, bytes([i % 6]))
        for i in range(900)
    ]
    df = spark.createDataFrame(rows, "id long, n int, x double, s string, d date, t timestamp, b boolean, l array<int>, m map<string,int>, y binary").withColumn("c", F.lit(1).cast("decimal(9,2)"))
    monkeypatch.setattr(profiling, "TASK_VALUES", 512)
    found = profiling.profile(df.repartition(3))
    got = {r["name"]: r["unique_values"] for r in found.collect()}
    assert got == {"id": 900, "n": 7, "x": 2, "s": 11, "d": 9, "t": 24, "b": 2, "l": 3, "m": 5, "y": 6, "c": 1}
    plan = profiling._distinct_counts(df, [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "REPARTITION_BY_NUM" in plan
    assert {r["unique_values"] for r in profiling.profile(df.limit(0)).collect()} == {0}
