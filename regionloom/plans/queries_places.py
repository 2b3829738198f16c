"""Nearest places, radius counts, footprints, polygons, surfaces and graphs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from regionloom.functions import geo
from regionloom.functions.geo import EARTH_MILES
from regionloom.operators import aggregates, footprints, graph, neighbours, surfaces
from regionloom.plans.registry import query
from regionloom.plans.views import CENTRE, EV, distance_sql, events, haversine_sql, located, located_sql, table
from regionloom.sources import writers

KM = haversine_sql("a.latitude", "a.longitude", "b.latitude", "b.longitude")
CU = f"cu AS (SELECT c_custkey, c_mktsegment AS source_key, c_acctbal, {located_sql('c_custkey')} FROM customer)"


def customers(spark, sf_dir):
    return located(table(spark, sf_dir, "customer"), "c_custkey").select(
        "c_custkey", F.col("c_mktsegment").alias("source_key"), "c_acctbal", "latitude", "longitude"
    )


def fires_and_others(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.where("source_key = 'error'"), ev.where("source_key <> 'error'")


@query(
    "nearest_distance",
    f"WITH {EV} SELECT a.event_id, round(min({KM}), 6) AS nearest_km FROM ev a, ev b WHERE a.source_key = 'error' AND b.source_key <> 'error' GROUP BY a.event_id",
)
def nearest_distance(spark, sf_dir):
    fires, others = fires_and_others(spark, sf_dir)
    return neighbours.nearest(fires, others).select("event_id", F.round("nearest_km", 6).alias("nearest_km"))


@query("nearest_of_nothing", "SELECT s_suppkey, NULL::DOUBLE AS nearest_km FROM supplier")
def nearest_of_nothing(spark, sf_dir):
    suppliers = located(table(spark, sf_dir, "supplier"), "s_suppkey")
    return neighbours.nearest(suppliers, suppliers.where("s_suppkey < 0")).select("s_suppkey", "nearest_km")


@query(
    "counts_within_radii",
    f"""WITH {EV} SELECT b.event_id, count(*) FILTER ({KM} <= 1) AS count_within_1km, count(*) FILTER ({KM} <= 3) AS count_within_3km, count(*) FILTER ({KM} <= 5) AS count_within_5km
    FROM ev b, ev a WHERE b.source_key <> 'error' AND a.source_key = 'error' GROUP BY b.event_id""",
)
def counts_within_radii(spark, sf_dir):
    fires, others = fires_and_others(spark, sf_dir)
    return neighbours.within_counts(others, fires, [1, 3, 5]).select("event_id", "count_within_1km", "count_within_3km", "count_within_5km")


@query(
    "geometry_intersections",
    f"""WITH {EV} SELECT a.source_key AS source_a, b.source_key AS source_b, count(*) AS n_pairs FROM ev a JOIN ev b ON a.source_key < b.source_key
    AND b.latitude BETWEEN a.latitude - 0.03 AND a.latitude + 0.03 AND b.longitude BETWEEN a.longitude - 0.04 AND a.longitude + 0.04 WHERE {KM} <= 3 GROUP BY ALL""",
)
def geometry_intersections(spark, sf_dir):
    return neighbours.geometry_intersections(events(spark, sf_dir), 3.0)


@query(
    "region_distances",
    f"""WITH {CU}, n AS (SELECT a.source_key AS source_a, b.source_key AS source_b, a.c_custkey, min({KM}) AS km FROM cu a JOIN cu b ON a.source_key <> b.source_key GROUP BY ALL),
    c AS (SELECT source_key, avg(latitude) AS latitude, avg(longitude) AS longitude FROM cu GROUP BY source_key)
    SELECT source_a, source_b, round(avg(km), 6) AS mean_nearest_km, round(min(km), 6) AS min_km, round(any_value({KM}), 4) AS centroid_km
    FROM n JOIN c a ON a.source_key = source_a JOIN c b ON b.source_key = source_b GROUP BY source_a, source_b""",
)
def region_distances(spark, sf_dir):
    d = neighbours.region_distances(customers(spark, sf_dir))
    return d.select(
        "source_a", "source_b", F.round("mean_nearest_km", 6).alias("mean_nearest_km"), F.round("min_km", 6).alias("min_km"), F.round("centroid_km", 4).alias("centroid_km")
    )


@query(
    "adjacency_edges",
    f"""WITH {EV}, p AS (SELECT DISTINCT latitude, longitude FROM ev) SELECT a.latitude AS lat_a, a.longitude AS lon_a, b.latitude AS lat_b, b.longitude AS lon_b, round({KM}, 6) AS km FROM p a JOIN p b
    ON b.latitude BETWEEN a.latitude - 0.01 AND a.latitude + 0.01 AND b.longitude BETWEEN a.longitude - 0.02 AND a.longitude + 0.02
    WHERE (a.latitude, a.longitude) < (b.latitude, b.longitude) AND {KM} <= 0.5""",
)
def adjacency_edges(spark, sf_dir):
    _, edges = graph.adjacency_graph(events(spark, sf_dir), 0.5)
    return edges.withColumn("km", F.round("km", 6))


@query("adjacency_nodes", f"WITH {EV} SELECT latitude AS lat, longitude AS lon, count(*) AS row_count FROM ev GROUP BY ALL")
def adjacency_nodes(spark, sf_dir):
    return neighbours.places(events(spark, sf_dir), "latitude", "longitude").select("lat", "lon", F.col("w").alias("row_count"))


_SCALED = f"""{CU}, z AS (SELECT c_custkey AS id, (latitude - avg(latitude) OVER ()) / stddev_pop(latitude) OVER () AS x, (longitude - avg(longitude) OVER ()) / stddev_pop(longitude) OVER () AS y,
    (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS w FROM cu)"""


@query(
    "knn_graph",
    f"""WITH {_SCALED}, d AS (SELECT a.id, b.id AS neighbour_id, sqrt((a.x - b.x)**2 + (a.y - b.y)**2 + (a.w - b.w)**2) AS distance FROM z a JOIN z b ON a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour_id) AS r FROM d) SELECT id, neighbour_id, round(distance, 4) AS distance, r::INTEGER AS rank FROM r WHERE r <= 5""",
)
def knn_graph(spark, sf_dir):
    return neighbours.knn_graph(customers(spark, sf_dir), ["latitude", "longitude", "c_acctbal"], 5, "c_custkey")


_KNN = f"""WITH {CU}, d AS (SELECT q.c_custkey AS id, t.c_acctbal, t.source_key, row_number() OVER (PARTITION BY q.c_custkey ORDER BY (q.latitude - t.latitude)**2 + (q.longitude - t.longitude)**2, t.c_custkey) AS r
    FROM cu q, cu t WHERE q.c_custkey % 3 = 0 AND t.c_custkey % 3 <> 0)"""


@query("knn_regression", _KNN + " SELECT id, round(avg(c_acctbal), 4) AS prediction FROM d WHERE r <= 3 GROUP BY id")
def knn_regression(spark, sf_dir):
    cu = customers(spark, sf_dir)
    p = neighbours.knn_predict(cu.where("c_custkey % 3 <> 0"), cu.where("c_custkey % 3 = 0"), ["latitude", "longitude"], "c_acctbal", 3, "c_custkey")
    return p.select("id", F.round("prediction", 4).alias("prediction"))


@query(
    "knn_classification",
    _KNN + ", v AS (SELECT id, source_key, count(*) AS n FROM d WHERE r <= 5 GROUP BY ALL) SELECT id, arg_min(source_key, (-n, source_key)) AS prediction FROM v GROUP BY id",
)
def knn_classification(spark, sf_dir):
    cu = customers(spark, sf_dir)
    return neighbours.knn_predict(
        cu.where("c_custkey % 3 <> 0"), cu.where("c_custkey % 3 = 0"), ["latitude", "longitude"], "source_key", 5, "c_custkey", continuous=False
    )


_VECTORS = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query(
    "knn_embeddings",
    f"""WITH {_VECTORS}, d AS (SELECT a.id, b.id AS neighbour_id, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour_id) AS r FROM d) SELECT id, neighbour_id, round(distance, 6) AS distance, r::INTEGER AS rank FROM r WHERE r <= 5""",
)
def knn_embeddings(spark, sf_dir):
    """The five nearest other vectors of every vector, in all 64 dimensions."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.k_nearest(rows, rows, "embedding", 5, "vec_id", exclude_same_id=True).withColumn("distance", F.round("distance", 6))


@query(
    "knn_labels_of_embeddings",
    f"""WITH {_VECTORS}, d AS (SELECT q.id, t.label, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, t.v), t.id) AS r FROM e q, e t WHERE q.id % 3 = 0 AND t.id % 3 <> 0),
    v AS (SELECT id, label, count(*) AS n FROM d WHERE r <= 5 GROUP BY ALL) SELECT id, arg_min(label, (-n, label)) AS prediction FROM v GROUP BY id""",
)
def knn_labels_of_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.knn_predict(rows.where("vec_id % 3 <> 0"), rows.where("vec_id % 3 = 0"), "embedding", "label", 5, "vec_id", continuous=False)


_PARTS = """p AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, p_retailprice AS b, avg(l_quantity) AS c, avg(l_discount) AS d, avg(l_tax) AS e FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
    z AS (SELECT id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b, (c - avg(c) OVER ()) / stddev_pop(c) OVER () AS c,
    (d - avg(d) OVER ()) / stddev_pop(d) OVER () AS d, (e - avg(e) OVER ()) / stddev_pop(e) OVER () AS e FROM p)"""


@query(
    "knn_graph_of_parts",
    f"""WITH {_PARTS}, g AS (SELECT x.id, y.id AS neighbour_id, sqrt((x.a - y.a)**2 + (x.b - y.b)**2 + (x.c - y.c)**2 + (x.d - y.d)**2 + (x.e - y.e)**2) AS distance FROM z x JOIN z y ON x.id <> y.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour_id) AS r FROM g) SELECT id, neighbour_id, round(distance, 4) AS distance, r::INTEGER AS rank FROM r WHERE r <= 4""",
)
def knn_graph_of_parts(spark, sf_dir):
    """Parts that are alike in size, price and the means of their orders: five standardized features."""
    orders = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*[F.avg(f"l_{c}").alias(c) for c in ("quantity", "discount", "tax")])
    parts = table(spark, sf_dir, "part").join(orders, F.col("p_partkey") == F.col("l_partkey"))
    return neighbours.knn_graph(parts, ["p_size", "p_retailprice", "quantity", "discount", "tax"], 4, "p_partkey")


# ---------------------------------------------------------------- footprints


@query("point_cloud", f"WITH {EV} SELECT round(latitude, 6) AS lat, round(longitude, 6) AS lon FROM ev WHERE {distance_sql(EARTH_MILES)} <= 15")
def point_cloud(spark, sf_dir):
    texts = events(spark, sf_dir).select(F.col("latitude").cast("string").alias("y"), F.col("longitude").cast("string").alias("x"))
    cloud = footprints.point_cloud_or_centroids(texts, ["lat", "y"], ["x"], "county", None, CENTRE, 15.0)
    return cloud.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("hull_extents", f"WITH {EV} SELECT source_key, count(*) AS n, min(longitude) AS west, max(longitude) AS east, min(latitude) AS south, max(latitude) AS north FROM ev GROUP BY source_key")
def hull_extents(spark, sf_dir):
    """The bounding box of every hull is that of its points."""
    hulls = footprints.convex_hull(events(spark, sf_dir), "source_key", "latitude", "longitude")
    lons, lats = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    return hulls.select(
        "source_key", "n", F.array_min(lons).alias("west"), F.array_max(lons).alias("east"), F.array_min(lats).alias("south"), F.array_max(lats).alias("north")
    )


@query("convex_hulls")
def convex_hulls(spark, sf_dir):
    hulls = footprints.convex_hull(events(spark, sf_dir), "source_key", "latitude", "longitude")
    return hulls.select("source_key", "n", F.size("ring").alias("corners"), F.round(geo.ring_area_km2("ring"), 2).alias("area_km2"))


@query("buffered_points", "SELECT s_suppkey, 64 AS corners, round(0.5 * 64 * sin(radians(360.0 / 64)) * 0.0025, 8) AS area FROM supplier")
def buffered_points(spark, sf_dir):
    discs = footprints.buffer(located(table(spark, sf_dir, "supplier"), "s_suppkey"), 0.05, "latitude", "longitude")
    return discs.select("s_suppkey", F.size("ring").alias("corners"), F.round(geo.ring_area("ring"), 8).alias("area"))


_BOXES = f"""{EV}, part_of AS (SELECT * FROM ev WHERE (source_key, ts) IN (SELECT source_key, ts FROM ev) AND latitude > 42 + length(source_key) / 50.0 AND longitude < -121 - length(source_key) / 40.0),
    box AS (SELECT source_key AS k, min(longitude) AS w, max(longitude) AS e, min(latitude) AS s, max(latitude) AS n, min(ts) AS t0, max(ts) AS t1 FROM part_of GROUP BY source_key),
    pairs AS (SELECT a.k AS source_a, b.k AS source_b, greatest(0, least(a.e, b.e) - greatest(a.w, b.w)) * greatest(0, least(a.n, b.n) - greatest(a.s, b.s)) * 12321 AS area,
    greatest(a.t0, b.t0) AS t0, least(a.t1, b.t1) AS t1 FROM box a JOIN box b ON a.k < b.k)"""


def _boxes(spark, sf_dir):
    """A rectangle and a time range per source."""
    size = F.length("source_key")
    ev = events(spark, sf_dir).where((F.col("latitude") > 42 + size / 50.0) & (F.col("longitude") < -121 - size / 40.0))
    box = aggregates.spatial_summary(ev, ["source_key"])

    def corner(lon, lat):
        return F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"))

    ring = F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"))
    return box.select("source_key", ring.alias("ring")), aggregates.time_ranges_by(ev, "ts")


@query("footprint_overlap_of_boxes", f"WITH {_BOXES} SELECT source_a, source_b, round(area, 2) AS area_km2 FROM pairs WHERE area > 0")
def footprint_overlap_of_boxes(spark, sf_dir):
    rings, _ = _boxes(spark, sf_dir)
    return footprints.footprint_overlap(rings).select("source_a", "source_b", "area_km2")


@query("footprint_overlap_of_hulls")
def footprint_overlap_of_hulls(spark, sf_dir):
    hulls = footprints.convex_hull(events(spark, sf_dir), "source_key", "latitude", "longitude")
    return writers.overlap_summary(footprints.footprint_overlap(hulls))


@query("time_overlap", f"WITH {_BOXES} SELECT source_a, source_b, t0 AS time_start, t1 AS time_end, CAST(floor((epoch_us(t1) - epoch_us(t0)) / 86400000000) AS BIGINT) AS overlap_days FROM pairs WHERE t0 <= t1")
def time_overlap(spark, sf_dir):
    _, ranges = _boxes(spark, sf_dir)
    return footprints.time_overlap(ranges)


@query(
    "spacetime_overlap",
    f"""WITH {_BOXES} SELECT source_a, source_b, round(area, 2) AS area_km2, area > 0 AS spatial_overlap, t0 <= t1 AS temporal_overlap,
    CAST(floor((epoch_us(t1) - epoch_us(t0)) / 86400000000) AS BIGINT) AS overlap_days, strftime(t0, '%Y-%m-%d') AS time_start, strftime(t1, '%Y-%m-%d') AS time_end FROM pairs""",
)
def spacetime_overlap(spark, sf_dir):
    rings, ranges = _boxes(spark, sf_dir)
    return footprints.spacetime_overlap(rings, ranges).drop("geometry")


@query("layer_relationships", f"WITH {_BOXES} SELECT source_a, source_b, 'space' AS kind, round(area, 2) AS weight FROM pairs WHERE area > 0 UNION ALL SELECT source_a, source_b, 'time', floor((epoch_us(t1) - epoch_us(t0)) / 86400000000) FROM pairs WHERE t0 <= t1")
def layer_relationships(spark, sf_dir):
    rings, ranges = _boxes(spark, sf_dir)
    return footprints.layer_relationships(footprints.spacetime_overlap(rings, ranges))


@query(
    "time_overlap_of_customers",
    """WITH r AS (SELECT o_custkey AS k, min(o_orderdate)::TIMESTAMP AS t0, min(o_orderdate)::TIMESTAMP + INTERVAL (count(*)) DAY AS t1 FROM orders GROUP BY o_custkey),
    p AS (SELECT a.k AS source_a, floor((epoch_us(least(a.t1, b.t1)) - epoch_us(greatest(a.t0, b.t0))) / 86400000000) AS days FROM r a JOIN r b ON a.k < b.k AND a.t0 <= b.t1 AND b.t0 <= a.t1)
    SELECT source_a, count(*) AS n_later, sum(days)::BIGINT AS overlap_days FROM p GROUP BY source_a""",
)
def time_overlap_of_customers(spark, sf_dir):
    """How often the windows that customers open with their first order (a day for each of their orders) meet."""
    start = F.min("o_orderdate").cast("timestamp")
    ranges = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(start.alias("time_start"), F.count(F.lit(1)).alias("n"))
    ranges = ranges.withColumn("time_end", F.timestamp_micros(F.unix_micros("time_start") + F.col("n") * 86_400_000_000))
    return footprints.time_overlap_totals(ranges.drop("n"), by="k")


# ---------------------------------------------------------------- polygons

_DIAMOND = "d AS (SELECT n_nationkey, 42.0200317 + n_nationkey * 0.0391 AS cy, -121.9300171 + ((n_nationkey * 7) % 25) * 0.0347 AS cx, 0.0312345 + (n_nationkey % 4) * 0.0507 AS r FROM nation)"


def diamonds(spark, sf_dir):
    n = F.col("n_nationkey")
    shaped = table(spark, sf_dir, "nation").select(
        "n_nationkey", (F.lit(42.0200317) + n * 0.0391).alias("cy"), (F.lit(-121.9300171) + ((n * 7) % 25) * 0.0347).alias("cx"), (F.lit(0.0312345) + (n % 4) * 0.0507).alias("r")
    )

    def corner(dx, dy):
        return F.struct((F.col("cx") + dx * F.col("r")).alias("lon"), (F.col("cy") + dy * F.col("r")).alias("lat"))

    return shaped.select("n_nationkey", F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1)).alias("ring"))


@query("points_in_polygons", f"WITH {EV}, {_DIAMOND} SELECT event_id, n_nationkey FROM ev JOIN d ON abs(longitude - cx) + abs(latitude - cy) < r")
def points_in_polygons(spark, sf_dir):
    return footprints.spatial_join(events(spark, sf_dir), diamonds(spark, sf_dir), "n_nationkey").select("event_id", "n_nationkey")


@query("polygon_filter", f"WITH {EV}, {_DIAMOND} SELECT DISTINCT event_id FROM ev JOIN d ON abs(longitude - cx) + abs(latitude - cy) < r")
def polygon_filter(spark, sf_dir):
    return footprints.polygon_filter(events(spark, sf_dir), diamonds(spark, sf_dir), "n_nationkey", "event_id").select("event_id")


_STARS = """c AS (SELECT n_nationkey, 42.0200317 + n_nationkey * 0.0391 AS cy, -121.9300171 + ((n_nationkey * 7) % 25) * 0.0347 AS cx FROM nation),
    v AS (SELECT n_nationkey, k, cx + 0.11 * (1 + 0.4 * sin(9 * pi() * k / 150)) * cos(pi() * k / 150) AS x, cy + 0.11 * (1 + 0.4 * sin(9 * pi() * k / 150)) * sin(pi() * k / 150) AS y FROM c, range(300) t(k)),
    g AS (SELECT a.n_nationkey, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM v a JOIN v b ON b.n_nationkey = a.n_nationkey AND b.k = (a.k + 1) % 300)"""


@query(
    "points_in_stars",
    f"""WITH {EV}, {_STARS} SELECT event_id, n_nationkey FROM ev JOIN g ON (py > latitude) <> (qy > latitude) AND longitude < px + (latitude - py) / (qy - py) * (qx - px)
    GROUP BY event_id, n_nationkey HAVING count(*) % 2 = 1""",
)
def points_in_stars(spark, sf_dir):
    """Points in outlines of three hundred edges that are not convex: each point meets the edges of its band."""
    n = F.col("n_nationkey")
    centres = table(spark, sf_dir, "nation").select(
        "n_nationkey", (F.lit(42.0200317) + n * 0.0391).alias("cy"), (F.lit(-121.9300171) + ((n * 7) % 25) * 0.0347).alias("cx")
    )

    def corner(k):
        t = F.lit(math.pi) * k / 150
        far = 0.11 * (1 + 0.4 * F.sin(9 * t))
        return F.struct((F.col("cx") + far * F.cos(t)).alias("lon"), (F.col("cy") + far * F.sin(t)).alias("lat"))

    stars = centres.select("n_nationkey", F.transform(F.sequence(F.lit(0), F.lit(299)), corner).alias("ring"))
    return footprints.spatial_join(events(spark, sf_dir), stars, "n_nationkey").select("event_id", "n_nationkey")


# ---------------------------------------------------------------- surfaces

_GRID = f"""{EV}, b AS (SELECT min(latitude) AS s, max(latitude) AS n, min(longitude) AS w, max(longitude) AS e FROM ev),
    g AS (SELECT (i // 24)::INTEGER AS row, (i % 24)::INTEGER AS col, s + (n - s) * (i // 24) / 23 AS gy, w + (e - w) * (i % 24) / 23 AS gx FROM b, range(576) t(i))"""


@query("risk_surface", f"WITH {_GRID} SELECT row, col, round(gy, 6) AS grid_lat, round(gx, 6) AS grid_lon, round(sum(value * exp(-((gy - latitude)**2 + (gx - longitude)**2) / (2 * 0.05 * 0.05))), 4) AS risk FROM g, ev GROUP BY ALL")
def risk_surface(spark, sf_dir):
    s = surfaces.risk_surface(events(spark, sf_dir), 0.05, 24, "value")
    return s.select("row", "col", F.round("grid_lat", 6).alias("grid_lat"), F.round("grid_lon", 6).alias("grid_lon"), F.round("risk", 4).alias("risk"))


@query(
    "spatial_interpolation",
    f"""WITH {_GRID}, q AS (SELECT row, col, value, (gy - latitude)**2 + (gx - longitude)**2 AS sq FROM g, ev)
    SELECT row, col, round(coalesce(avg(value) FILTER (sq = 0), sum(value / nullif(sq, 0)) / sum(1 / nullif(sq, 0))), 6) AS estimate FROM q GROUP BY row, col""",
)
def spatial_interpolation(spark, sf_dir):
    return surfaces.spatial_interpolation(events(spark, sf_dir), 24, "value").select("row", "col", F.round("estimate", 6).alias("estimate"))


# ---------------------------------------------------------------- graphs


@query("network_components", "SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS component FROM supplier QUALIFY count(*) OVER (PARTITION BY s_nationkey) > 1")
def network_components(spark, sf_dir):
    """Suppliers linked to the next supplier of their nation: one component per nation."""
    from pyspark.sql import Window

    ahead = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    edges = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.lead("s_suppkey").over(ahead).alias("b")).where("b IS NOT NULL")
    return graph.components(edges)


@query("spatial_network_summary")
def spatial_network_summary(spark, sf_dir):
    edges = graph.spatial_network(customers(spark, sf_dir), ["latitude", "longitude"], 2, "c_custkey")
    return graph.network_summary(edges)


@query(
    "spatial_network_degrees",
    f"""WITH {CU}, r AS (SELECT a.c_custkey AS a, b.c_custkey AS b, row_number() OVER (PARTITION BY a.c_custkey ORDER BY (a.latitude - b.latitude)**2 + (a.longitude - b.longitude)**2, b.c_custkey) AS r FROM cu a JOIN cu b ON a.c_custkey <> b.c_custkey),
    e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM r WHERE r <= 2) SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id""",
)
def spatial_network_degrees(spark, sf_dir):
    return graph.degrees(graph.spatial_network(customers(spark, sf_dir), ["latitude", "longitude"], 2, "c_custkey"))
