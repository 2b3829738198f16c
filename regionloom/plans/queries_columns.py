"""Sources, projection, filters, positions, set operations, scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T

from regionloom.functions import geo, scalars
from regionloom.operators import columns, filters, joins, positions, tables
from regionloom.plans.registry import query
from regionloom.plans.views import CENTRE, EV, OBS, distance_sql, events, located, located_sql, observations, table, with_distance
from regionloom.session import spread
from regionloom.sources import archives, metadata, readers, writers

# ---------------------------------------------------------------- flagship


@query(
    "near_county_compare",
    f"""WITH {OBS} SELECT county, count(*) AS observation_count, round(sum(metric_value), 2) AS metric_sum,
    round(avg(metric_value), 4) AS metric_mean FROM obs WHERE {distance_sql()} <= 40 GROUP BY county""",
)
def near_county_compare(spark, sf_dir):
    from regionloom.operators.aggregates import county_compare

    compared = county_compare(filters.near(observations(spark, sf_dir), CENTRE, 40.0))
    return compared.withColumns({"metric_sum": F.round("metric_sum", 2), "metric_mean": F.round("metric_mean", 4)})


# ---------------------------------------------------------------- sources


def _landed(df, folder_name):
    """A folder in the staging area for round trips through a file format."""
    import uuid

    from regionloom.session import staging_folder

    return f"{staging_folder(df.sparkSession)}/{folder_name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = _landed(df, "csv")
    writers.write_csv(df, path)
    return readers.read_csv(spark, path, df.schema)


@query("json_round_trip", "SELECT event_id, user_id, event_type, value, props FROM events")
def json_round_trip(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    path = _landed(df, "json")
    writers.write_json(df, path)
    return readers.read_json_payloads(spark, path, schema=df.schema, per_line=True)


_FEATURE = "properties struct<event_id:bigint,event_type:string>, geometry struct<type:string,coordinates:array<double>>"


@query("geojson_features", f"WITH {EV} SELECT event_id, source_key AS event_type, longitude, latitude FROM ev")
def geojson_features(spark, sf_dir):
    """Newline-delimited features written and read back."""
    ev = events(spark, sf_dir)
    features = ev.select(
        F.struct("event_id", F.col("source_key").alias("event_type")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
    )
    path = _landed(ev, "geojson")
    writers.write_json(features, path)
    read = readers.read_geojson(spark, path, schema=_FEATURE, per_line=True)
    return read.select(
        "event_id", "event_type", F.get("geometry.coordinates", F.lit(0)).alias("longitude"), F.get("geometry.coordinates", F.lit(1)).alias("latitude")
    )


@query("feature_service_pages", f"WITH {EV} SELECT event_id, value, longitude, latitude FROM ev")
def feature_service_pages(spark, sf_dir):
    """Pages of features (one per 1,000 ids) written as documents and read back."""
    ev = events(spark, sf_dir)
    feature = F.struct(
        F.struct("event_id", "value").alias("attributes"), F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y")).alias("geometry")
    )
    pages = ev.groupBy(F.floor(F.col("event_id") / 1000).alias("page")).agg(F.collect_list(feature).alias("features"))
    path = _landed(ev, "pages")
    pages.select("features").write.json(path)
    schema = "features array<struct<attributes:struct<event_id:bigint,value:double>,geometry:struct<x:double,y:double>>>"
    return readers.read_arcgis_pages(spark, path, schema, per_line=True)


@query("header_array_payloads", "SELECT event_id, 'NAME' AS field, event_type AS text FROM events UNION ALL SELECT event_id, 'VALUE', CAST(event_id AS VARCHAR) FROM events")
def header_array_payloads(spark, sf_dir):
    """``[[names],[values]]`` texts to maps."""
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.to_json(F.array(F.array(F.lit("NAME"), F.lit("VALUE")), F.array("event_type", F.col("event_id").cast("string")))).alias("payload"),
    )
    record = scalars.header_row_map(F.from_json("payload", "array<array<string>>"))
    return raw.select("event_id", F.explode(record).alias("field", "text"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    "fetch_tables",
    "SELECT 'customer' AS __source__, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier",
)
def fetch_tables(spark, sf_dir):
    named = {k: table(spark, sf_dir, k) for k in ("customer", "supplier", "nation")}
    return readers.fetch(named, ["customer", "supplier"]).groupBy("__source__").agg(F.count(F.lit(1)).alias("n"))


@query("export_filtered_observations", f"WITH {OBS} SELECT source_key, count(*) AS n, round(sum(metric_value), 2) AS total FROM obs WHERE county = 'NATION_3' AND year BETWEEN 1996 AND 1999 GROUP BY source_key")
def export_filtered_observations(spark, sf_dir):
    obs = observations(spark, sf_dir)
    path = _landed(obs, "observations")
    writers.export_observations(obs, {"county": "NATION_3", "year_min": 1996, "year_max": 1999}, path)
    back = readers.read_csv(spark, path, T.StructType([f for f in obs.schema.fields if f.name != "source_key"] + [T.StructField("source_key", T.StringType())]))
    return back.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("metric_value"), 2).alias("total"))


@query(
    "field_dictionary",
    """SELECT CAST(p_partkey AS VARCHAR) AS source_key, 'f_' || p_brand AS field_name, p_name AS description FROM part
       UNION ALL SELECT CAST(p_partkey AS VARCHAR), CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END, p_name FROM part""",
)
def field_dictionary(spark, sf_dir):
    """Both document forms, built from the part table and parsed as JSON text."""
    part = table(spark, sf_dir, "part")
    documents = part.select(
        F.col("p_partkey").cast("string").alias("source_key"),
        F.to_json(
            F.struct(
                F.array(
                    F.struct(F.concat(F.lit("f_"), "p_brand").alias("name"), F.col("p_name").alias("alias")),
                    F.struct(F.lit("no_alias").alias("name"), F.lit(None).cast("string").alias("alias")),
                ).alias("fields"),
                F.array(
                    F.struct(
                        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("fieldName"),
                        F.col("p_brand").alias("name"),
                        F.col("p_name").alias("description"),
                    )
                ).alias("columns"),
            )
        ).alias("text"),
    )
    parsed = documents.select("source_key", F.from_json("text", metadata.DOCUMENT_SCHEMA).alias("d")).select("source_key", "d.*")
    return metadata.field_dictionary_of(parsed)


@query(
    "metadata_urls",
    r"""WITH u AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'https://data.oregon.gov/resource/fa7z-' || event_id || '.csv'
        WHEN 1 THEN 'https://host/arcgis/rest/services/x/' || event_id || '/query?where=1' WHEN 2 THEN 'https://doi.org/10.1/' || event_id
        WHEN 3 THEN 'https://host/archive' || event_id || '.ZIP' ELSE 'https://api.figshare.com/v2/' || event_id END AS url,
        CASE event_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'arcgis_rest' WHEN 2 THEN 'research_ref' WHEN 3 THEN 'zip_csv' ELSE 'web_api' END AS kind FROM events)
    SELECT event_id, CASE kind WHEN 'csv' THEN 'https://data.oregon.gov/api/views/fa7z-' || event_id || '.json'
        WHEN 'arcgis_rest' THEN 'https://host/arcgis/rest/services/x/' || event_id || '?f=pjson' WHEN 'research_ref' THEN 'https://api.datacite.org/works/10.1/' || event_id
        WHEN 'zip_csv' THEN url || '#metadata_index' ELSE url END AS metadata_url FROM u""",
)
def metadata_urls(spark, sf_dir):
    n = F.col("event_id").cast("string")
    m = F.col("event_id") % 5
    url = (
        F.when(m == 0, F.concat(F.lit("https://data.oregon.gov/resource/fa7z-"), n, F.lit(".csv")))
        .when(m == 1, F.concat(F.lit("https://host/arcgis/rest/services/x/"), n, F.lit("/query?where=1")))
        .when(m == 2, F.concat(F.lit("https://doi.org/10.1/"), n))
        .when(m == 3, F.concat(F.lit("https://host/archive"), n, F.lit(".ZIP")))
        .otherwise(F.concat(F.lit("https://api.figshare.com/v2/"), n))
    )
    kind = F.when(m == 0, "csv").when(m == 1, "arcgis_rest").when(m == 2, "research_ref").when(m == 3, "zip_csv").otherwise("web_api")
    return table(spark, sf_dir, "events").select("event_id", metadata.metadata_url(url, kind).alias("metadata_url"))


@query(
    "source_keys_from_filenames",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'portal_dogami_slido' WHEN doc_id % 4 = 1 THEN 'portal_odf_firestats'
       WHEN doc_id % 4 = 2 THEN 'portal_sci_data_ics209_demo' ELSE source || '_' || lang || '_' || doc_id END AS source_key FROM documents""",
)
def source_keys_from_filenames(spark, sf_dir):
    m = F.col("doc_id") % 4
    stem = F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string"))
    name = (
        F.when(m == 0, F.concat(F.lit("SLIDO_"), "lang", F.lit(".csv")))
        .when(m == 1, F.concat(F.lit("my_odf_FireStats_"), "lang", F.lit(".csv")))
        .when(m == 2, F.lit("ICS209.csv"))
        .otherwise(F.concat(stem, F.lit(".csv")))
    )
    return table(spark, sf_dir, "documents").select("doc_id", metadata.source_key_from_filename(name).alias("source_key"))


# ---------------------------------------------------------------- projection and mutation


@query("subset_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def subset_columns(spark, sf_dir):
    chosen = columns.subset({"customer": table(spark, sf_dir, "customer")}, {"customer": ["c_custkey", "no_such", "c_mktsegment"], "gone": ["x"]})
    return chosen["customer"]


@query("rename_columns", "SELECT c_custkey AS customer_id, c_acctbal AS balance, c_mktsegment FROM customer")
def rename_columns(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return columns.name_columns(df, {"c_custkey": "customer_id", "c_acctbal": "balance", "c_mktsegment": "c_mktsegment", "zz": "y"})


@query("add_row_expression", "SELECT p_partkey, p_size * 2 AS twice, p_retailprice + p_size AS sum_both FROM part")
def add_row_expression(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    wide = columns.derive(columns.add_column(part, "twice", "part[p_size] * 2"), "sum_both", "p_retailprice + p_size")
    return wide.select("p_partkey", "twice", "sum_both")


@query(
    "add_aggregate_expression",
    """SELECT c_custkey, round((SELECT avg(o_totalprice) FROM orders) * 2.5, 4) AS scaled_mean,
       round(c_acctbal / (SELECT max(c_acctbal) FROM customer), 6) AS share FROM customer""",
)
def add_aggregate_expression(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    wide = columns.add_column(customer, "scaled_mean", "mean(orders[o_totalprice]) * 2.5D", {"orders": orders})
    wide = columns.add_column(wide, "share", "c_acctbal / max(c_acctbal)")
    return wide.select("c_custkey", F.round("scaled_mean", 4).alias("scaled_mean"), F.round("share", 6).alias("share"))


@query("mapped_column", "SELECT p_partkey, upper(p_name) AS p_name, round(p_retailprice * 0.3048, 4) AS metres FROM part")
def mapped_column(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    wide = columns.map_column(part, "p_name", F.upper)
    wide = columns.map_column(wide, "p_retailprice", lambda c: scalars.convert_unit(c, "ft", "m"), "metres")
    return wide.select("p_partkey", "p_name", F.round("metres", 4).alias("metres"))


@query(
    "mapped_rows",
    "SELECT r AS __row_id__, c_acctbal * 2 + 1 AS value FROM (SELECT c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) WHERE r >= 10 AND r < 1200",
)
def mapped_rows(spark, sf_dir):
    """A vectorized Python function over a selection of rows."""

    @F.pandas_udf(T.DoubleType())
    def double_and_one(v: pd.Series) -> pd.Series:
        return v * 2 + 1

    return columns.map_rows(table(spark, sf_dir, "customer"), "c_acctbal", double_and_one, "10..1200", "c_custkey")


@query("remove_and_exclude_columns", "SELECT s_suppkey, s_acctbal FROM supplier")
def remove_and_exclude_columns(spark, sf_dir):
    return columns.exclude_columns(columns.remove_column(table(spark, sf_dir, "supplier"), "s_name"), ["s_nationkey", "absent"])


@query("conditional_value", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def conditional_value(spark, sf_dir):
    return columns.set_if(table(spark, sf_dir, "supplier"), "s_acctbal < 0", "s_acctbal", 0.0).select("s_suppkey", "s_acctbal")


@query(
    "population_ratios",
    f"""WITH {OBS}, d AS (SELECT id, metric_value, {distance_sql()} AS distance_km FROM obs), p AS (SELECT CAST(count(*) AS DOUBLE) AS population FROM customer)
    SELECT id, population, round(population / greatest(distance_km, 0.1), 4) AS population_per_distance_km,
    round(coalesce(metric_value, 0) / greatest(population / 1000.0, 1.0), 4) AS metric_per_1000_people FROM d, p""",
)
def population_ratios(spark, sf_dir):
    people = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).cast("double").alias("population"))
    wide = columns.population_ratios(with_distance(observations(spark, sf_dir)), people)
    return wide.select(
        "id", "population", F.round("population_per_distance_km", 4).alias("population_per_distance_km"),
        F.round("metric_per_1000_people", 4).alias("metric_per_1000_people"),
    )


# ---------------------------------------------------------------- filters


@query(
    "filter_observations",
    f"WITH {OBS} SELECT id, county, year FROM obs WHERE source_key = '1-URGENT' AND year BETWEEN 1995 AND 2000 AND {distance_sql()} <= 30",
)
def filter_observations(spark, sf_dir):
    kept = filters.filter_observations(
        observations(spark, sf_dir), source_key="1-URGENT", county="", year_min=1995, year_max="2000", centre=CENTRE, radius_km=30
    )
    return kept.select("id", "county", "year")


@query("predicate_text", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def predicate_text(spark, sf_dir):
    return filters.where(table(spark, sf_dir, "orders"), "o_orderstatus = 'F' AND o_totalprice > 300000").select("o_orderkey")


@query("between_values", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
def between_values(spark, sf_dir):
    return filters.between(table(spark, sf_dir, "orders"), "o_totalprice", 100000, 150000).select("o_orderkey", "o_totalprice")


@query(
    "compare_signs",
    """WITH v AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
    SELECT 'ne' AS sign, event_id FROM v WHERE v IS DISTINCT FROM 5.0 UNION ALL SELECT 'ge', event_id FROM v WHERE v >= 20
    UNION ALL SELECT 'other', event_id FROM v""",
)
def compare_signs(spark, sf_dir):
    v = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    parts = [filters.apply_op(v, "v", op, x).select(F.lit(n).alias("sign"), "event_id") for n, op, x in (("ne", "!=", 5.0), ("ge", ">=", 20.0), ("other", "~", 1.0))]
    return tables.concat(*parts)


@query("near_miles", f"WITH {EV} SELECT event_id FROM ev WHERE {distance_sql(3958.8)} <= 20")
def near_miles(spark, sf_dir):
    return filters.near(events(spark, sf_dir), CENTRE, 20.0, earth=geo.EARTH_MILES).select("event_id")


@query("bounding_box", f"WITH {EV} SELECT event_id FROM ev WHERE longitude BETWEEN -121.7 AND -121.2 AND latitude BETWEEN 42.1 AND 42.4")
def bounding_box(spark, sf_dir):
    return filters.bbox(events(spark, sf_dir), -121.7, 42.1, -121.2, 42.4).select("event_id")


@query("remove_records", "SELECT event_id FROM events WHERE NOT coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END > 10, false)")
def remove_records(spark, sf_dir):
    v = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    return filters.remove_where(v, "v > 10").select("event_id")


# ---------------------------------------------------------------- cleaning


@query("first_present", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'b' || event_id WHEN event_id % 3 = 1 THEN event_type ELSE NULL END AS picked FROM events")
def first_present(spark, sf_dir):
    m = F.col("event_id") % 3
    wide = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(m == 1, F.col("event_type")).otherwise(F.lit("  ")).alias("County"),
        F.when(m == 0, F.concat(F.lit("b"), F.col("event_id").cast("string"))).alias("county_name"),
    )
    return wide.select("event_id", columns.first_present(wide, ["COUNTY", "county_name", "absent"]).alias("picked"))


@query(
    "normalize_observation_columns",
    f"""WITH {EV} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(2000 + event_id % 20 AS INTEGER) END AS year, round(latitude, 6) AS latitude,
    round(longitude, 6) AS longitude, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS metric_value, 'Field Events' AS source_label,
    round({distance_sql()}, 4) AS distance_km FROM ev""",
)
def normalize_observation_columns(spark, sf_dir):
    n = F.col("event_id")
    raw = events(spark, sf_dir).select(
        "event_id",
        F.when(n % 4 == 0, "n/a").otherwise(F.concat((2000 + n % 20).cast("string"), F.lit(".0"))).alias("fireyear"),
        F.col("latitude").cast("string").alias("lat_dd"),
        F.col("longitude").cast("string").alias("long_dd"),
        F.when(n % 3 == 0, "").otherwise(F.col("value").cast("string")).alias("esttotalacres"),
    )
    rows = columns.normalize_observations(raw, "field_events", CENTRE)
    return rows.select(
        "event_id", "year", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "metric_value",
        "source_label", F.round("distance_km", 4).alias("distance_km"),
    )


@query(
    "normalize_with_imputation",
    """SELECT s_suppkey, CAST(2020 + row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS year,
    round(CAST(42.5 + ((row_number() OVER (ORDER BY s_suppkey) - 1) % 5) * 0.005 AS DOUBLE), 6) AS latitude,
    round(CAST(-121.5 - ((row_number() OVER (ORDER BY s_suppkey) - 1) % 5) * 0.005 AS DOUBLE), 6) AS longitude,
    1.0::DOUBLE AS metric_value, 'Klamath' AS county FROM supplier""",
)
def normalize_with_imputation(spark, sf_dir):
    rows = columns.normalize_observations(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "supplier", CENTRE, impute=True, order_by="s_suppkey")
    return rows.select("s_suppkey", "year", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "metric_value", "county")


@query("numeric_and_time_coercion", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END AS number, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch(date_trunc('day', ts))::BIGINT END AS seconds FROM events")
def numeric_and_time_coercion(spark, sf_dir):
    n = F.col("event_id")
    text = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(n % 2 == 0, "1-2").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).alias("a"),
        F.when(n % 3 == 0, "soon").when(n % 3 == 1, F.date_format("ts", "MM/dd/yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("b"),
    )
    return text.select("event_id", scalars.to_numeric("a").alias("number"), scalars.epoch_seconds(scalars.to_time("b")).alias("seconds"))


@query("complete_cases", "SELECT event_id FROM events WHERE event_id % 6 <> 0 AND event_id % 5 <> 0")
def complete_cases(spark, sf_dir):
    n = F.col("event_id")
    wide = table(spark, sf_dir, "events").select(
        "event_id", F.when(n % 6 != 0, F.col("value")).alias("a"), F.when(n % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("b")
    )
    return columns.complete_cases(wide, ["a", "b"]).select("event_id")


@query("feature_matrix", "SELECT event_id, epoch(date_trunc('day', ts))::DOUBLE AS day_text, value FROM events")
def feature_matrix(spark, sf_dir):
    """Numbers, dates as epoch seconds, and no column that never has a value."""
    wide = table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day_text"), "value", F.lit("none").alias("never")
    )
    return columns.feature_matrix(wide, ["day_text", "value", "never", "absent"], keep=["event_id"]).drop("features")


@query("drop_constant_columns", "SELECT l_orderkey, l_quantity FROM lineitem")
def drop_constant_columns(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.lit(3.0).alias("flat"), F.lit(None).cast("double").alias("empty"))
    return columns.drop_constant(wide, ["l_quantity", "flat", "empty"])


@query("display_labels", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Now' ELSE array_to_string(list_transform(string_split(lower(o_orderpriority), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS label FROM orders")
def display_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.title_label("o_orderpriority", {"1-URGENT": "Now"}).alias("label"))


@query("type_casts", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS INTEGER) AS a FROM events")
def type_casts(spark, sf_dir):
    n = F.col("event_id")
    text = table(spark, sf_dir, "events").select("event_id", F.when(n % 4 == 0, "x").otherwise(n.cast("string")).alias("a"))
    return columns.type_cast(text, {"a": "int", "absent": "int"})


@query(
    "zscore_and_minmax",
    """SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS z,
    round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 6) AS scaled FROM part""",
)
def zscore_and_minmax(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("z"), F.col("p_size").cast("double").alias("scaled"))
    wide = columns.normalize(columns.normalize(part, ["z"]), ["scaled"], "minmax")
    return wide.select("p_partkey", F.round("z", 6).alias("z"), F.round("scaled", 6).alias("scaled"))


@query("split_by_value", "SELECT 'O' AS part, o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'F', o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'P', o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def split_by_value(spark, sf_dir):
    parts = columns.split(table(spark, sf_dir, "orders"), "o_orderstatus", ["O", "F", "P"])
    return tables.concat(*[d.select(F.lit(v).alias("part"), "o_orderkey") for v, d in parts.items()])


@query("command_buffer", "SELECT o_orderkey, o_totalprice, o_totalprice / 1000 AS thousands FROM orders WHERE o_orderstatus <> 'P' AND NOT o_totalprice < 50000")
def command_buffer(spark, sf_dir):
    commands = [
        {"type": "exclude_columns", "columns": ["o_orderpriority", "o_custkey", "o_orderdate"]},
        {"type": "filter", "predicate": "o_orderstatus <> 'P'"},
        {"type": "derive", "new": "thousands", "expression": "o_totalprice / 1000"},
        {"type": "remove_where", "predicate": "o_totalprice < 50000"},
        {"type": "exclude_columns", "columns": ["o_orderstatus"]},
    ]
    return columns.run_commands(table(spark, sf_dir, "orders"), commands)


# ---------------------------------------------------------------- positions


@query("number_rows", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS __row_id__ FROM orders")
def number_rows(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return positions.number_rows(df, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "__row_id__")


@query(
    "number_rows_by_key",
    "SELECT l_orderkey, l_linenumber, l_returnflag, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS place FROM lineitem",
)
def number_rows_by_key(spark, sf_dir):
    keys = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", *keys)
    return positions.number_rows(df, keys, by=["l_returnflag"], name="place").select("l_orderkey", "l_linenumber", "l_returnflag", "place")


@query(
    "index_slice",
    "SELECT __row_id__ - 100 AS __row_id__, c_name, c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS __row_id__ FROM customer) WHERE __row_id__ >= 100 AND __row_id__ < 900",
)
def index_slice(spark, sf_dir):
    return positions.index(table(spark, sf_dir, "customer"), "100..900", "c_name, c_acctbal, absent", "c_custkey")


@query("remove_row_range", "SELECT c_custkey FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) WHERE NOT (r >= 10 AND r < 500)")
def remove_row_range(spark, sf_dir):
    return positions.remove_rows(table(spark, sf_dir, "customer").select("c_custkey"), "10..500", "c_custkey")


@query(
    "append_by_position",
    """WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer), b AS (SELECT s_acctbal, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier)
    SELECT c_custkey, s_acctbal AS balance FROM a LEFT JOIN b USING (r)""",
)
def append_by_position(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    return positions.append_column(customer, table(spark, sf_dir, "supplier"), "s_acctbal", "balance", "c_custkey", "s_suppkey").select("c_custkey", "balance")


@query(
    "align_by_position",
    """WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS r FROM part), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer)
    SELECT p_partkey, c_custkey, r - 1 AS __row_id__ FROM a JOIN b USING (r)""",
)
def align_by_position(spark, sf_dir):
    a = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    b = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return positions.align_by_position(a, b, ["p_retailprice", "p_partkey"], ["c_acctbal", "c_custkey"]).select("p_partkey", "c_custkey", "__row_id__")


@query(
    "cross_pair",
    f"""WITH {OBS}, a AS (SELECT id AS id_a, latitude AS lat_a, longitude AS lon_a, row_number() OVER (ORDER BY id) - 1 AS __row_id__ FROM obs WHERE source_key = '1-URGENT'),
    b AS (SELECT id AS id_b, latitude AS lat_b, longitude AS lon_b, row_number() OVER (ORDER BY id) - 1 AS __row_id__ FROM obs WHERE source_key = '5-LOW')
    SELECT __row_id__, id_a, lat_a, lon_a, id_b, lat_b, lon_b FROM a JOIN b USING (__row_id__)""",
)
def cross_pair(spark, sf_dir):
    obs = observations(spark, sf_dir)

    def side(source, s):
        rows = obs.where(F.col("source_key") == source)
        return rows.select(F.col("id").alias(f"id_{s}"), F.col("latitude").alias(f"lat_{s}"), F.col("longitude").alias(f"lon_{s}"))

    return positions.align_by_position(side("1-URGENT", "a"), side("5-LOW", "b"), "id_a", "id_b")


# ---------------------------------------------------------------- sets, sorts, samples, joins


@query(
    "fuse_sources",
    """SELECT __source__, count(*) AS n, count(c_acctbal) AS balances, count(s_suppkey) AS suppliers, count(kind) AS kinds FROM (
    SELECT c_acctbal, NULL AS s_suppkey, c_mktsegment AS kind, 'customer' AS __source__ FROM customer
    UNION ALL SELECT NULL, s_suppkey, CAST(s_nationkey AS VARCHAR), 'supplier' FROM supplier) GROUP BY __source__""",
)
def fuse_sources(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "kind")
    supplier = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "kind")
    fused = tables.fuse({"customer": customer, "supplier": supplier})
    return fused.groupBy("__source__").agg(
        F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("balances"), F.count("s_suppkey").alias("suppliers"), F.count("kind").alias("kinds")
    )


@query("concat_derived", "SELECT o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1")
def concat_derived(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parts = [orders.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")) for c in ("o_orderpriority", "o_orderstatus")]
    return tables.concat(*parts)


@query("add_literal_rows", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NEW'")
def add_literal_rows(spark, sf_dir):
    return tables.add_rows(table(spark, sf_dir, "region"), [(99, "NEW")])


@query("distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_values(spark, sf_dir):
    return tables.distinct(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("sorted_rows", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC")
def sorted_rows(spark, sf_dir):
    return tables.sort(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], descending=True)


@query("head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def head_rows(spark, sf_dir):
    return tables.head(table(spark, sf_dir, "orders"), 100, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("bar_data", "SELECT c_mktsegment AS x, c_acctbal AS y FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
def bar_data(spark, sf_dir):
    return tables.bar_data(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", ["c_acctbal", "c_custkey"])


@query(
    "top_per_key",
    "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5",
)
def top_per_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return tables.top_k(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 5, by=["o_orderpriority"])


@query("deterministic_sample", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':42'), o_orderkey LIMIT 500")
def deterministic_sample(spark, sf_dir):
    return tables.deterministic_sample(table(spark, sf_dir, "orders"), 500, "o_orderkey").select("o_orderkey")


@query(
    "map_points_per_source",
    f"""WITH {OBS} SELECT id, source_key, source_key AS label, latitude, longitude FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY md5(id || ':42'), id) AS r FROM obs) WHERE r <= 500""",
)
def map_points_per_source(spark, sf_dir):
    from regionloom.operators.footprints import map_points

    return map_points(observations(spark, sf_dir), 500).withColumn("label", F.col("source_key"))


@query(
    "join_fires_population",
    """SELECT o_orderpriority, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
)
def join_fires_population(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "custkey")
    joined = joins.join_sources(orders, customer, "custkey")
    return joined.groupBy("o_orderpriority", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("join_without_match", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_without_match(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.join_sources(table(spark, sf_dir, "customer"), orders, "c_custkey", "left_anti").select("c_custkey")


@query(
    "centroids_of_counties",
    f"""WITH {OBS}, c AS (SELECT n_name AS county, 42 + n_nationkey / 100.0 AS lat, -121 - n_nationkey / 100.0 AS lon FROM nation WHERE n_nationkey < 20)
    SELECT DISTINCT county, round(lat, 4) AS lat, round(lon, 4) AS lon FROM obs JOIN c USING (county)""",
)
def centroids_of_counties(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_nationkey < 20")
    centroids = nation.select(
        F.col("n_name").alias("county"), F.round(42 + F.col("n_nationkey") / 100.0, 4).alias("lat"), F.round(-121 - F.col("n_nationkey") / 100.0, 4).alias("lon")
    )
    return joins.centroid_fallback(observations(spark, sf_dir), "county", centroids)


# ---------------------------------------------------------------- scalar functions


@query(
    "distances",
    f"""WITH {EV} SELECT event_id, round({distance_sql()}, 4) AS km, round({distance_sql(6371.0)} * 0.621371, 4) AS miles,
    round((latitude - 42.5) * 111.0, 4) AS flat_km, round((longitude + 121.5) * 69.0 * cos(radians(latitude)), 4) AS flat_miles, round({distance_sql()} * 1609.34, 2) AS metres FROM ev""",
)
def distances(spark, sf_dir):
    km = geo.haversine("latitude", "longitude", *CENTRE)
    return events(spark, sf_dir).select(
        "event_id",
        F.round(km, 4).alias("km"),
        F.round(geo.km_to_miles(geo.haversine("latitude", "longitude", *CENTRE, geo.EARTH_KM_ROUND)), 4).alias("miles"),
        F.round(geo.degrees_to_km(F.col("latitude") - 42.5), 4).alias("flat_km"),
        F.round(geo.degrees_to_miles(F.col("longitude") + 121.5, "latitude"), 4).alias("flat_miles"),
        F.round(geo.miles_to_metres(km), 2).alias("metres"),
    )


@query(
    "date_functions",
    """SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, CAST(floor((epoch(TIMESTAMP '2000-06-01') - epoch(o_orderdate)) / 86400) AS BIGINT) AS days,
    strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""",
)
def date_functions(spark, sf_dir):
    day = F.lit("2000-06-01").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", scalars.epoch_seconds("o_orderdate").alias("seconds"), scalars.days_between("o_orderdate", day).alias("days"),
        scalars.iso_date("o_orderdate").alias("day"), scalars.to_year(F.concat(F.year("o_orderdate").cast("string"), F.lit(".0"))).alias("year"),
    )


@query(
    "text_functions",
    r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '1-2' WHEN 1 THEN '-1.5' WHEN 2 THEN '1.2.3' WHEN 3 THEN '$1,234.50' WHEN 4 THEN ' 7 ' ELSE p_name END AS s,
    CASE p_partkey % 3 WHEN 0 THEN 'area_FT2' WHEN 1 THEN 'depth_km' ELSE 'name' END AS c FROM part)
    SELECT p_partkey, p_partkey % 6 IN (0, 1) AS numeric_look, CASE WHEN p_partkey % 6 = 3 THEN 1234.5 WHEN p_partkey % 6 = 1 THEN -1.5 WHEN p_partkey % 6 = 4 THEN 7.0 ELSE NULL END::DOUBLE AS money,
    CASE p_partkey % 3 WHEN 0 THEN 'ft2' WHEN 1 THEN 'km' ELSE NULL END AS unit, greatest(p_partkey / 100.0, 3.0)::DOUBLE AS floored FROM t""",
)
def text_functions(spark, sf_dir):
    m = F.col("p_partkey") % 6
    s = F.when(m == 0, "1-2").when(m == 1, "-1.5").when(m == 2, "1.2.3").when(m == 3, "$1,234.50").when(m == 4, " 7 ").otherwise(F.col("p_name"))
    c = F.when(F.col("p_partkey") % 3 == 0, "area_FT2").when(F.col("p_partkey") % 3 == 1, "depth_km").otherwise("name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalars.looks_numeric(s).alias("numeric_look"), scalars.currency(s).alias("money"), scalars.unit_suffix(c).alias("unit"),
        scalars.at_least(F.col("p_partkey") / 100.0, 3.0).alias("floored"),
    )


@query(
    "rings_and_points",
    f"""WITH {EV} SELECT event_id, round(0.5 * 64 * sin(radians(360.0 / 64)) * 0.01 * 12321.0, 4) AS disc_km2,
    '{{"type":"Point"' AS head, true AS has_centre, false AS has_far FROM ev""",
)
def rings_and_points(spark, sf_dir):
    ring = geo.disc_ring("longitude", "latitude", 0.1)
    wide = spread(events(spark, sf_dir)).withColumn("ring", ring)
    return wide.select(
        "event_id",
        F.round(geo.ring_area_km2("ring"), 4).alias("disc_km2"),
        F.substring(geo.point_geojson("longitude", "latitude"), 1, 15).alias("head"),
        geo.rings_contain("ring", F.col("longitude"), F.col("latitude")).alias("has_centre"),
        geo.rings_contain("ring", F.col("longitude") + 0.2, F.col("latitude")).alias("has_far"),
    )


@query(
    "radius_outlines",
    f"""WITH s AS (SELECT s_suppkey, {located_sql('s_suppkey')} FROM supplier) SELECT s_suppkey, d::INTEGER AS degree, round(longitude + 50 / 69.0 / cos(radians(latitude)) * cos(radians(d)), 6) AS lon,
    round(latitude + 50 / 69.0 * sin(radians(d)), 6) AS lat FROM s, range(361) t(d)""",
)
def radius_outlines(spark, sf_dir):
    ring = geo.radius_outline("latitude", "longitude", 50.0)
    points = located(table(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", F.posexplode(ring).alias("degree", "p"))
    return points.select("s_suppkey", "degree", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query("geometry_from_columns", f"WITH {EV} SELECT event_id, longitude AS lon, latitude AS lat FROM ev")
def geometry_from_columns(spark, sf_dir):
    """Columns to GeoJSON text and back to a point."""
    text = events(spark, sf_dir).select("event_id", geo.point_geojson("longitude", "latitude").alias("g"))
    return text.select("event_id", geo.point_from_geojson("g").alias("p")).select("event_id", "p.lon", "p.lat")


@query(
    "sample_by_fraction",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || substr(md5(o_orderkey || ':42'), 1, 8))::BIGINT / 4294967296.0 < 0.3",
)
def sample_by_fraction(spark, sf_dir):
    return tables.sample_fraction(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 0.3, "o_orderkey")


@query("add_median", "SELECT p_partkey, p_retailprice - (SELECT median(p_retailprice) FROM part) AS above FROM part")
def add_median(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return columns.add_column(part, "above", "k[p_retailprice] - median(k[p_retailprice])", {"k": part}).select("p_partkey", "above")


@query("json_records_at_path", "SELECT c_custkey, c_name FROM customer")
def json_records_at_path(spark, sf_dir):
    """Documents whose records lie in an array inside: a document for each nation and hundred customers."""
    customer = table(spark, sf_dir, "customer")
    records = customer.groupBy("c_nationkey", F.floor(F.col("c_custkey") / 100)).agg(F.collect_list(F.struct("c_custkey", "c_name")).alias("rows"))
    path = _landed(customer, "records")
    writers.write_json(records.select(F.struct("rows").alias("data")), path)
    schema = "data struct<rows:array<struct<c_custkey:bigint,c_name:string>>>"
    return readers.read_json_payloads(spark, path, "data.rows", schema, per_line=True)


@query("header_array_files", "SELECT CAST(o_orderkey AS VARCHAR) AS order_key, o_orderpriority AS priority FROM orders")
def header_array_files(spark, sf_dir):
    """``[[names],[values]]`` payloads, one on each line, for every order."""
    orders = table(spark, sf_dir, "orders")
    values = F.array(F.col("o_orderkey").cast("string"), "o_orderpriority")
    payload = F.to_json(F.array(F.array(F.lit("KEY"), F.lit("PRIORITY")), values))
    path = _landed(orders, "arrays")
    orders.select(payload.alias("value")).write.text(path)
    record = readers.read_header_arrays(spark, path, per_line=True)
    return record.select(F.col("record")["KEY"].alias("order_key"), F.col("record")["PRIORITY"].alias("priority"))


@query(
    "zipped_orders",
    "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total, min(strftime(o_orderdate, '%Y-%m-%d')) AS first_day FROM orders GROUP BY o_orderpriority",
)
def zipped_orders(spark, sf_dir):
    """Orders written to ZIP archives of CSV members and read back, a partition for each member."""
    orders = table(spark, sf_dir, "orders")
    path = _landed(orders, "archives")
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    archives.write_zipped_csv(orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", day).repartition(4), path, rows_per_member=20_000)
    back = readers.read_zipped_csv(spark, path, "o_custkey bigint, o_orderpriority string, o_totalprice double, day string")
    return back.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("day").alias("first_day")
    )


@query(
    "fetch_first_rows",
    """SELECT * FROM (SELECT 'customer' AS __source__, c_custkey AS key FROM customer ORDER BY c_custkey LIMIT 7)
    UNION ALL SELECT * FROM (SELECT 'supplier', s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 7)""",
)
def fetch_first_rows(spark, sf_dir):
    """The first rows of each table by its key; the limit is the feature."""
    named = {k: table(spark, sf_dir, k).select(F.col(c).alias("key")) for k, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"))}
    return readers.fetch(named, limit=7, order_by={"customer": "key", "supplier": "key"}).select("__source__", "key")


@query(
    "profile_file",
    "SELECT 'o_orderkey' AS name, count(DISTINCT o_orderkey) AS unique_values, count(*) - count(o_orderkey) AS null_count FROM orders UNION ALL SELECT 'o_custkey' AS name, count(DISTINCT o_custkey) AS unique_values, count(*) - count(o_custkey) AS null_count FROM orders UNION ALL SELECT 'o_orderpriority' AS name, count(DISTINCT o_orderpriority) AS unique_values, count(*) - count(o_orderpriority) AS null_count FROM orders",
)
def profile_file(spark, sf_dir):
    """A profile written as CSV and read back."""
    from regionloom.operators import profiling

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    path = _landed(orders, "profile")
    writers.write_profile(profiling.profile(orders), path, "csv")
    back = readers.read_csv(spark, path, ", ".join(f"`{t}` string" for t in writers.PROFILE_HEADER.values()))
    counts = [F.col(f"`{writers.PROFILE_HEADER[c]}`").cast("bigint").alias(c) for c in ("unique_values", "null_count")]
    return back.select(F.col("`Column Name`").alias("name"), *counts)


@query(
    "profile_of_parts",
    "SELECT 'o_orderkey' AS name, count(*) AS n, count(*) - count(o_orderkey) AS null_count, min(o_orderkey)::DOUBLE AS low, max(o_orderkey)::DOUBLE AS high, 'numeric' AS inferred_type, true AS near FROM orders "
    "UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice), min(o_totalprice), max(o_totalprice), 'numeric', true FROM orders "
    "UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority), NULL, NULL, 'categorical', true FROM orders",
)
def profile_of_parts(spark, sf_dir):
    """States of the orders of old and of later years, put together; the estimates are near the exact counts of all."""
    from regionloom.operators import profiling

    orders = table(spark, sf_dir, "orders")
    chosen = ["o_orderkey", "o_totalprice", "o_orderpriority"]
    states = [profiling.profile_state(orders.where(part).select(*chosen)) for part in (F.year("o_orderdate") < 1995, F.year("o_orderdate") >= 1995)]
    found = profiling.profile_of_state(profiling.merge_states(states))
    exact = profiling.profile(orders.select(*chosen)).select(F.col("name").alias("of"), F.col("unique_values").alias("exact"))
    near = F.abs(F.col("unique_values") / F.col("exact") - 1) <= profiling.DISTINCT_ERROR
    return found.join(exact, F.col("name") == F.col("of")).select("name", "n", "null_count", "low", "high", "inferred_type", near.alias("near"))
