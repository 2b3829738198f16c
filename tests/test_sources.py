import json
import zipfile

from pyspark.sql import functions as F

from regionloom.sources import archives, metadata, readers, writers


def test_csv_keeps_bad_records(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("name,value\nalpha,1\nbeta,oops\n")
    rows = readers.read_csv(spark, str(path), "name string, value int", keep_bad=True).orderBy("name").collect()
    assert [(r["name"], r["value"]) for r in rows] == [("alpha", 1), ("beta", None)]
    assert rows[1][readers.BAD_RECORD] == "beta,oops"
    assert readers.read_csv(spark, str(path)).count() == 2


def test_geojson_document(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"n": i, "k": "a"}, "geometry": {"type": "Point", "coordinates": [float(i), 2.0]}} for i in range(3)
    ]
    path = tmp_path / "p.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    df = readers.read_geojson(spark, str(path))
    assert set(df.columns) == {"n", "k", "geometry"} and df.count() == 3


def test_arcgis_pages(spark, tmp_path):
    for page in range(2):
        body = {"features": [{"attributes": {"id": page * 10 + i}, "geometry": {"x": -121.0 - i, "y": 42.0}} for i in range(2)]}
        (tmp_path / f"page{page}.json").write_text(json.dumps(body))
    got = {tuple(r) for r in readers.read_arcgis_pages(spark, str(tmp_path)).select("id", "longitude", "latitude").collect()}
    assert got == {(0, -121.0, 42.0), (1, -122.0, 42.0), (10, -121.0, 42.0), (11, -122.0, 42.0)}


def test_payloads(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"data": {"rows": [{"a": 1}, {"a": 2}]}}))
    assert [r["a"] for r in readers.read_json_payloads(spark, str(tmp_path / "x.json"), "data.rows").orderBy("a").collect()] == [1, 2]
    (tmp_path / "h.json").write_text('[["NAME","B01003_001E"],\n["Klamath Falls","22000"]]')
    record = readers.read_header_arrays(spark, str(tmp_path / "h.json")).first()["record"]
    assert record == {"NAME": "Klamath Falls", "B01003_001E": "22000"}


def test_zipped_csv(spark, tmp_path):
    for n in range(2):
        with zipfile.ZipFile(tmp_path / f"z{n}.zip", "w") as z:
            z.writestr("in/one.csv", "a,b\n1,x\n2,\n")
            z.writestr("readme.txt", "no rows")
            z.writestr("two.csv", "b,c,a\ny,0,bad\n")
            z.writestr("empty.csv", "")
            z.writestr("header.csv", "a,b\n")
    df = readers.read_zipped_csv(spark, str(tmp_path / "*.zip"), "a int, b string")
    rows = sorted(((r["a"], r["b"]) for r in df.collect()), key=str)
    assert rows == sorted([(1, "x"), (2, None), (None, "y")] * 2, key=str)
    assert df.rdd.getNumPartitions() == 8  # one for each member
    assert readers.read_zipped_csv(spark, f"file://{tmp_path}", "a int", members="in/*").count() == 4
    assert readers.read_zipped_csv(spark, str(tmp_path / "none*.zip"), "a int").collect() == []


def test_zipped_csv_is_written_and_read_again(spark, tmp_path):
    rows = [(i, f'text "{i}", with\nbreaks' if i % 3 else None) for i in range(250)]
    archives.write_zipped_csv(spark.createDataFrame(rows, "a int, b string").repartition(3), str(tmp_path / "out"), rows_per_member=20)
    df = readers.read_zipped_csv(spark, str(tmp_path / "out"), "a int, b string")
    assert df.rdd.getNumPartitions() >= 12 and sorted(map(tuple, df.collect())) == rows
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"part-{i:05d}.zip" for i in range(3)]


def test_fetch_limits_each_table(spark):
    a, b = spark.range(10).toDF("x"), spark.range(5).toDF("y")
    counts = dict(readers.fetch({"a": a, "b": b}, ["a", "b", "zz"], limit=3).groupBy("__source__").count().collect())
    assert counts == {"a": 3, "b": 3}


def test_field_dictionary(spark, tmp_path):
    (tmp_path / "arc.json").write_text(json.dumps({"fields": [{"name": "GACC", "alias": "Area"}, {"name": "z"}]}))
    (tmp_path / "soc.json").write_text(json.dumps({"columns": [{"fieldName": "f", "name": "F", "description": "d"}, {"name": "G", "description": "e"}, {"name": "H"}]}))
    got = {tuple(r) for r in metadata.field_dictionary(spark, str(tmp_path)).collect()}
    assert got == {("arc", "GACC", "Area"), ("soc", "f", "d"), ("soc", "G", "e")}


def test_profile_and_overlap_files(spark, tmp_path):
    profile = spark.createDataFrame([("a", "string", None, 0, 1)], "name string, inferred_type string, inferred_unit_tag string, null_count long, unique_values long")
    writers.write_profile(profile, str(tmp_path / "p"), "csv")
    writers.write_profile(profile, str(tmp_path / "j"))
    back = spark.read.option("header", True).csv(str(tmp_path / "p"))
    assert back.columns == ["Column Name", "Inferred Type", "Unit/Tag", "Null Count", "Unique Values", "Human Description"]
    pairs = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 5.0)], "source_a string, source_b string, area_km2 double")
    writers.write_overlap_summary(pairs, str(tmp_path / "o"))
    assert [r["area_km2"] for r in writers.overlap_summary(pairs).collect()] == [5.0, 1.0]


def test_split_write(spark, tmp_path):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    writers.split_write(df, "k", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("k = 1").count() == 3
