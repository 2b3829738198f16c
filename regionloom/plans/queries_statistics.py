"""Aggregates, bins, correlations, profiles and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionloom.functions import scalars
from regionloom.operators import aggregates, bins, correlation, joins, profiling, sampling
from regionloom.operators.quantiles import exact_quantiles
from regionloom.plans.registry import query
from regionloom.plans.views import CENTRE, EV, OBS, distance_sql, events, observations, table, with_distance
from regionloom.sources import writers

DIST = f"dist AS (SELECT *, {distance_sql()} AS distance_km FROM obs)"


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---------------------------------------------------------------- grouped summaries


@query(
    "yearly_means",
    f"""WITH {OBS} SELECT source_key, year, count(metric_value) AS metric_value_count, round(sum(metric_value), 2) AS metric_value_sum,
    round(avg(metric_value), 4) AS metric_value_mean, min(metric_value) AS metric_value_min, max(metric_value) AS metric_value_max FROM obs GROUP BY source_key, year""",
)
def yearly_means(spark, sf_dir):
    return rounded(rounded(aggregates.aggregate_source(observations(spark, sf_dir), ["source_key", "year"]), 2, "metric_value_sum"), 4, "metric_value_mean")


@query(
    "county_compare",
    f"WITH {OBS} SELECT county, count(*) AS observation_count, round(sum(metric_value), 2) AS metric_sum, round(avg(metric_value), 4) AS metric_mean FROM obs GROUP BY county",
)
def county_compare(spark, sf_dir):
    return rounded(rounded(aggregates.county_compare(observations(spark, sf_dir)), 2, "metric_sum"), 4, "metric_mean")


@query(
    "distance_stats",
    f"""WITH {OBS}, {DIST}, s AS (SELECT source_key, CAST(count(*) AS DOUBLE) AS "count", avg(distance_km) AS "mean", median(distance_km) AS "median", min(distance_km) AS "min", max(distance_km) AS "max" FROM dist GROUP BY source_key)
    SELECT source_key, stat, round(distance_km, 6) AS distance_km FROM s UNPIVOT (distance_km FOR stat IN ("count", "mean", "median", "min", "max"))""",
)
def distance_stats(spark, sf_dir):
    return rounded(aggregates.distance_stats(with_distance(observations(spark, sf_dir))), 6, "distance_km")


@query(
    "pivot_distance_stats",
    f"""WITH {OBS}, {DIST} SELECT source_key, CAST(count(*) AS DOUBLE) AS "count", round(avg(distance_km), 6) AS "mean", round(median(distance_km), 6) AS "median",
    round(min(distance_km), 6) AS "min", round(max(distance_km), 6) AS "max" FROM dist GROUP BY source_key""",
)
def pivot_distance_stats(spark, sf_dir):
    stats = aggregates.distance_stats(with_distance(observations(spark, sf_dir)))
    return rounded(aggregates.pivot_stats(stats), 6, "mean", "median", "min", "max")


@query(
    "quantiles_by_source",
    f"""WITH {OBS}, q AS (SELECT source_key, quantile_cont(metric_value, [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]) AS v FROM obs GROUP BY source_key)
    SELECT source_key, unnest([0.0, 0.1, 0.25, 0.5, 0.9, 1.0])::DOUBLE AS q, round(unnest(v), 4) AS value FROM q""",
)
def quantiles_by_source(spark, sf_dir):
    return rounded(exact_quantiles(observations(spark, sf_dir), "metric_value", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0], by=["source_key"]), 4, "value")


@query(
    "load_report",
    f"""WITH {OBS}, {EV} SELECT 'obs' AS source_key, count(*) AS rows_total, count(*) FILTER ({distance_sql()} <= 30) AS rows_in_radius, 11 AS columns, 'ok' AS status FROM obs
    UNION ALL SELECT 'ev', count(*), count(*) FILTER ({distance_sql()} <= 30), 8, 'ok' FROM ev UNION ALL SELECT 'nation', count(*), count(*), 3, 'ok' FROM nation""",
)
def load_report(spark, sf_dir):
    named = {"obs": observations(spark, sf_dir), "ev": events(spark, sf_dir), "nation": table(spark, sf_dir, "nation")}
    return aggregates.load_report(named, CENTRE, 30.0)


@query(
    "trend_by_source",
    f"""WITH {OBS} SELECT source_key, count(*) AS n, round(regr_slope(metric_value, year), 4) AS slope, round(regr_intercept(metric_value, year), 1) AS intercept,
    round(regr_r2(metric_value, year), 8) AS r2 FROM obs GROUP BY source_key""",
)
def trend_by_source(spark, sf_dir):
    t = aggregates.trend(observations(spark, sf_dir), "year", "metric_value", by=["source_key"])
    return t.select("source_key", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 1).alias("intercept"), F.round("r2", 8).alias("r2"))


@query("conditional_mean_curve", f"WITH {OBS} SELECT year, round(avg(metric_value), 4) AS metric_value_mean FROM obs GROUP BY year")
def conditional_mean_curve(spark, sf_dir):
    return rounded(aggregates.conditional_mean_curve(observations(spark, sf_dir), "year", "metric_value"), 4, "metric_value_mean")


@query("compare_datasets", f"WITH {OBS} SELECT source_key, count(*) AS row_count, round(avg(metric_value), 4) AS metric_mean FROM obs WHERE source_key IN ('1-URGENT', '5-LOW') GROUP BY source_key")
def compare_datasets(spark, sf_dir):
    return rounded(aggregates.compare_datasets(observations(spark, sf_dir), ["1-URGENT", "5-LOW"]), 4, "metric_mean")


@query("dataset_trends", f"WITH {OBS} SELECT source_key, year, round(avg(metric_value), 4) AS metric_mean FROM obs GROUP BY source_key, year")
def dataset_trends(spark, sf_dir):
    return rounded(aggregates.dataset_trends(observations(spark, sf_dir)), 4, "metric_mean")


@query("county_counts", f"WITH {OBS}, o AS (SELECT CASE WHEN year = 1995 THEN '' ELSE county END AS county FROM obs) SELECT coalesce(nullif(county, ''), 'Unknown') AS county, count(*) AS row_count FROM o GROUP BY 1")
def county_counts(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("county", F.when(F.col("year") == 1995, "").otherwise(F.col("county")))
    return aggregates.county_counts(obs)


@query(
    "sankey_links",
    f"""WITH {OBS}, l AS (SELECT 0 AS level, source_key AS source, dataset_category AS target FROM obs UNION ALL SELECT 1, dataset_category, county FROM obs UNION ALL SELECT 2, county, metric_name FROM obs),
    f AS (SELECT level, source, target, count(*) AS value FROM l GROUP BY ALL), n AS (SELECT DISTINCT level, source AS node FROM f UNION SELECT level + 1, target FROM f),
    i AS (SELECT level, node, row_number() OVER (ORDER BY level, node) - 1 AS id FROM n)
    SELECT f.level, source, target, value, a.id AS source_id, b.id AS target_id FROM f JOIN i a ON a.level = f.level AND a.node = source JOIN i b ON b.level = f.level + 1 AND b.node = target""",
)
def sankey_links(spark, sf_dir):
    return aggregates.sankey_links(observations(spark, sf_dir))


@query(
    "cross_domain_compare",
    f"WITH {OBS} SELECT dataset_category, year, count(*) AS row_count, round(avg(metric_value), 4) AS metric_mean FROM obs GROUP BY ALL",
)
def cross_domain_compare(spark, sf_dir):
    return rounded(correlation.cross_domain_compare(observations(spark, sf_dir)), 4, "metric_mean")


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    "cross_domain_correlation",
    f"""WITH {OBS}, y AS (SELECT dataset_category AS c, year, avg(metric_value) AS m FROM obs GROUP BY ALL)
    SELECT a.c AS x, b.c AS y, round(corr(a.m, b.m), 6) AS r FROM y a JOIN y b ON a.year = b.year AND a.c < b.c GROUP BY ALL""",
)
def cross_domain_correlation(spark, sf_dir):
    return rounded(correlation.cross_domain_correlation(observations(spark, sf_dir), _REGIONS), 6, "r")


@query(
    "matrix_compare",
    f"""WITH {OBS}, v AS (SELECT source_key AS k, [count(*)::DOUBLE, avg(metric_value), stddev_samp(metric_value), avg(latitude), avg(longitude)] AS v FROM obs GROUP BY source_key)
    SELECT a.k AS source_a, b.k AS source_b, round(list_cosine_similarity(a.v, b.v), 8) AS cosine FROM v a JOIN v b ON a.k < b.k""",
)
def matrix_compare(spark, sf_dir):
    return rounded(correlation.matrix_compare(observations(spark, sf_dir)), 8, "cosine")


@query("regions", f"WITH {OBS} SELECT DISTINCT 'county' AS kind, county AS value FROM obs UNION SELECT 'city', city FROM obs UNION SELECT 'category', dataset_category FROM obs")
def regions(spark, sf_dir):
    return aggregates.regions(observations(spark, sf_dir))


@query("probability", "SELECT o_orderkey, round((SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) FROM orders), 8) AS probability FROM orders")
def probability(spark, sf_dir):
    wide = aggregates.probability(table(spark, sf_dir, "orders"), "o_orderstatus", "F")
    return rounded(wide.select("o_orderkey", "probability"), 8, "probability")


@query(
    "bayes",
    """WITH c AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE AS na, (count(*) FILTER (o_orderpriority = '5-LOW'))::DOUBLE AS nb,
    (count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '5-LOW'))::DOUBLE AS nab FROM orders) SELECT o_orderkey, round((nab / na) * (na / n) / (nb / n), 8) AS bayes FROM orders, c""",
)
def bayes(spark, sf_dir):
    wide = aggregates.bayes(table(spark, sf_dir, "orders"), "o_orderstatus", "F", "o_orderpriority", "5-LOW")
    return rounded(wide.select("o_orderkey", "bayes"), 8, "bayes")


@query(
    "regression_prediction",
    f"""WITH {OBS}, l AS (SELECT regr_slope(metric_value, year) AS s, regr_intercept(metric_value, year) AS i FROM obs) SELECT id, round(i + s * year, 2) AS prediction FROM obs, l""",
)
def regression_prediction(spark, sf_dir):
    return aggregates.regression_prediction(observations(spark, sf_dir), "year", "metric_value").select("id", F.round("prediction", 2).alias("prediction"))


@query(
    "column_summary",
    """WITH l AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS variable, unnest([l_quantity, l_extendedprice, l_discount]) AS v FROM lineitem)
    SELECT variable, count(v) AS "count", round(avg(v), 6) AS "mean", round(stddev_samp(v), 4) AS "std", min(v) AS "min", max(v) AS "max",
    round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75 FROM l GROUP BY variable""",
)
def column_summary(spark, sf_dir):
    s = aggregates.summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(rounded(s, 6, "mean"), 4, "std", "q25", "q50", "q75")


@query(
    "missingness",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS event_type FROM events)
    SELECT 'event_id' AS "column", count(*) FILTER (event_id IS NULL) AS null_count, round(avg((event_id IS NULL)::INT), 8) AS null_share FROM t
    UNION ALL SELECT 'value', count(*) FILTER (value IS NULL), round(avg((value IS NULL)::INT), 8) FROM t
    UNION ALL SELECT 'event_type', count(*) FILTER (event_type = ''), round(avg((event_type = '')::INT), 8) FROM t""",
)
def missingness(spark, sf_dir):
    n = F.col("event_id")
    t = table(spark, sf_dir, "events").select(
        "event_id", F.when(n % 3 != 0, F.col("value")).alias("value"), F.when(n % 5 == 0, "").otherwise(F.col("event_type")).alias("event_type")
    )
    return rounded(aggregates.missingness(t), 8, "null_share")


@query("temporal_summary", "SELECT date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS row_count, min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY 1")
def temporal_summary(spark, sf_dir):
    return aggregates.temporal_summary(table(spark, sf_dir, "events"), "ts", "day")


@query(
    "spatial_summary",
    f"""WITH {EV} SELECT source_key, count(*) AS row_count, min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east,
    round(avg(latitude), 6) AS centre_lat, round(avg(longitude), 6) AS centre_lon, 0.0::DOUBLE AS null_share FROM ev GROUP BY source_key""",
)
def spatial_summary(spark, sf_dir):
    return rounded(aggregates.spatial_summary(events(spark, sf_dir), ["source_key"]), 6, "centre_lat", "centre_lon")


@query(
    "interaction_grid",
    f"""WITH {OBS} SELECT floor(longitude / 0.0625)::BIGINT AS cell_x, floor(latitude / 0.0625)::BIGINT AS cell_y, round(sum(metric_value), 2) AS z_sum, round(avg(metric_value), 4) AS z_mean, count(*) AS row_count FROM obs GROUP BY 1, 2""",
)
def interaction_grid(spark, sf_dir):
    grid = aggregates.interaction_grid(observations(spark, sf_dir), 0.0625, "longitude", "latitude", "metric_value")
    return rounded(rounded(grid, 2, "z_sum"), 4, "z_mean")


@query("time_ranges", "SELECT 'orders' AS source_key, 'o_orderdate' AS \"column\", min(o_orderdate) AS time_start, max(o_orderdate) AS time_end FROM orders UNION ALL SELECT 'events', 'ts', min(ts), max(ts) FROM events")
def time_ranges(spark, sf_dir):
    named = {k: table(spark, sf_dir, k) for k in ("orders", "events", "nation")}
    return aggregates.time_ranges(named, {"orders": ["absent", "o_orderstatus", "o_orderdate"], "events": ["ts"], "nation": ["x"]})


@query("coverage_timeline", f"WITH {EV} SELECT source_key, min(ts) AS time_start, max(ts) AS time_end, CAST(floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 86400) AS BIGINT) AS days FROM ev GROUP BY source_key")
def coverage_timeline(spark, sf_dir):
    return aggregates.coverage_timeline(aggregates.time_ranges_by(events(spark, sf_dir), "ts"))


# ---------------------------------------------------------------- bins

_BINS = f"""WITH {OBS}, {DIST}, l AS (SELECT source_key, unnest(['metric_value', 'distance_km', 'year']) AS variable, unnest([metric_value, distance_km, year::DOUBLE]) AS v FROM dist),
  s AS (SELECT source_key, variable, min(v) AS lo, max(v) AS hi, least(5, count(DISTINCT v)) AS b FROM l GROUP BY ALL),
  e AS (SELECT source_key, variable, lo, hi, b, unnest(range(b)) AS bin FROM s),
  g0 AS (SELECT source_key, variable, bin::INTEGER AS bin, CASE WHEN bin = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + bin * ((hi - lo) / b) END AS a, CASE WHEN bin = b - 1 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / b) END AS z FROM e),
  g AS (SELECT *, CASE WHEN abs(a) >= 1 OR a = 0 THEN round(a, 3) ELSE round(a, ceil(-log10(abs(a)))::INT + 2) END AS a3, CASE WHEN abs(z) >= 1 OR z = 0 THEN round(z, 3) ELSE round(z, ceil(-log10(abs(z)))::INT + 2) END AS z3 FROM g0)"""


@query(
    "frequency_bins",
    _BINS
    + """, c AS (SELECT g.source_key, g.variable, bin, a3, z3, count(v) AS n FROM g LEFT JOIN l ON l.source_key = g.source_key AND l.variable = g.variable AND v > a AND v <= z GROUP BY ALL)
    SELECT source_key, variable, bin, printf('%.2f to %.2f', a3, z3) AS bin_label, a3 AS bin_low, z3 AS bin_high, round((a3 + z3) / 2, 6) AS bin_midpoint, n AS "count" FROM c""",
)
def frequency_bins(spark, sf_dir):
    obs = with_distance(observations(spark, sf_dir))
    return rounded(bins.frequency_bins(obs, ["metric_value", "distance_km", "year"], 5), 6, "bin_midpoint")


@query(
    "histogram",
    """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), g AS (SELECT b::INTEGER AS bin, CASE WHEN b = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + b * ((hi - lo) / 10) END AS a, CASE WHEN b = 9 THEN hi ELSE lo + (b + 1) * ((hi - lo) / 10) END AS z FROM s, range(10) t(b))
    SELECT bin, round(a, 3) AS bin_low, round(z, 3) AS bin_high, (SELECT count(*) FROM lineitem WHERE l_extendedprice > a AND l_extendedprice <= z) AS "count" FROM g""",
)
def histogram(spark, sf_dir):
    return bins.distribution(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10).select("bin", "bin_low", "bin_high", "count")


@query(
    "bin_labels_on_rows",
    _BINS + """ SELECT id, printf('%.2f to %.2f', a3, z3) AS bin_label FROM obs JOIN g ON g.source_key = obs.source_key AND variable = 'metric_value' AND metric_value > a AND metric_value <= z""",
)
def bin_labels_on_rows(spark, sf_dir):
    return bins.distribution_bin(observations(spark, sf_dir), "metric_value", 5).select("id", "bin_label")


# ---------------------------------------------------------------- correlations


@query(
    "correlation_pairs",
    """WITH c AS (SELECT unnest(['l_quantity', 'l_quantity', 'l_extendedprice']) AS x, unnest(['l_extendedprice', 'l_tax', 'l_tax']) AS y,
    unnest([corr(l_quantity, l_extendedprice), corr(l_quantity, l_tax), corr(l_extendedprice, l_tax)]) AS r FROM lineitem)
    SELECT x, y, round(r, 8) AS r FROM c UNION ALL SELECT y, x, round(r, 8) FROM c UNION ALL SELECT unnest(['l_quantity', 'l_extendedprice', 'l_tax']), unnest(['l_quantity', 'l_extendedprice', 'l_tax']), 1.0""",
)
def correlation_pairs(spark, sf_dir):
    return rounded(correlation.selected_correlation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), 8, "r")


@query(
    "correlation_matrix",
    """WITH t AS (SELECT l_quantity AS q, l_extendedprice AS p, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS d FROM lineitem)
    SELECT 'q' AS variable, 1.0::DOUBLE AS q, round(corr(q, p), 8) AS p, round(corr(q, d), 8) AS d FROM t UNION ALL SELECT 'p', round(corr(q, p), 8), 1.0, round(corr(p, d), 8) FROM t UNION ALL SELECT 'd', round(corr(q, d), 8), round(corr(p, d), 8), 1.0 FROM t""",
)
def correlation_matrix(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.when(F.col("l_linenumber") != 1, F.col("l_discount")).alias("d")
    )
    return rounded(correlation.correlation_matrix(t), 8, "q", "p", "d")


@query("correlation_weights", "SELECT unnest(['l_quantity', 'l_discount']) AS feature, round(unnest([corr(l_quantity, l_extendedprice), corr(l_discount, l_extendedprice)]), 8) AS weight FROM lineitem")
def correlation_weights(spark, sf_dir):
    return rounded(correlation.correlation_weights(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice"), 8, "weight")


_SAMPLES = """s AS (SELECT event_type AS k, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || ':42'), event_id) AS r FROM events)"""


@query(
    "sampled_cross_correlation",
    f"""WITH {_SAMPLES}, m AS (SELECT least(500, min(n)) AS n FROM (SELECT count(*) AS n FROM events GROUP BY event_type))
    SELECT a.k AS source_a, b.k AS source_b, round(corr(a.value, b.value), 6) AS r, 'sampled' AS pairing FROM s a JOIN s b ON a.r = b.r, m
    WHERE a.r <= m.n AND a.k < b.k GROUP BY ALL""",
)
def sampled_cross_correlation(spark, sf_dir):
    ev = events(spark, sf_dir)
    series = {k: ev.where(F.col("source_key") == k) for k in ("click", "error", "purchase", "signup", "view")}
    return rounded(correlation.cross_source_correlation(series, "value", "event_id"), 6, "r")


@query(
    "keyed_cross_correlation",
    f"""WITH {OBS}, m AS (SELECT source_key AS k, county, year, avg(metric_value) AS v FROM obs GROUP BY ALL)
    SELECT a.k AS x, b.k AS y, round(corr(a.v, b.v), 6) AS r FROM m a JOIN m b ON a.county = b.county AND a.year = b.year AND a.k < b.k GROUP BY ALL""",
)
def keyed_cross_correlation(spark, sf_dir):
    sources = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return rounded(correlation.keyed_cross_correlation(observations(spark, sf_dir), ["county", "year"], sources), 6, "r")


@query(
    "regression_summary",
    """WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), s AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM t),
    f AS (SELECT *, sxy / sxx AS b, syy - sxy * sxy / sxx AS rss FROM s), g AS (SELECT *, my - b * mx AS a, sqrt(rss / (n - 2)) AS sigma FROM f)
    SELECT 'success' AS status, n::BIGINT AS n, round(a, 4) AS intercept, round(b, 6) AS slope, round(sigma, 4) AS sigma, round(sigma / sqrt(sxx), 6) AS slope_se,
    round(sigma * sqrt(1 / n + mx * mx / sxx), 4) AS intercept_se, round(b / (sigma / sqrt(sxx)), 4) AS slope_t, round(1 - rss / syy, 8) AS r_squared,
    round(1 - (rss / syy) * (n - 1) / (n - 2), 8) AS adj_r_squared, round(-0.5 * n * (ln(2 * pi()) + ln(rss / n) + 1), 2) AS log_lik,
    round(6 + n * (ln(2 * pi()) + ln(rss / n) + 1), 2) AS aic, round(3 * ln(n) + n * (ln(2 * pi()) + ln(rss / n) + 1), 2) AS bic FROM g""",
)
def regression_summary(spark, sf_dir):
    r = correlation.regression_summary(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    digits = {"intercept": 4, "slope": 6, "sigma": 4, "slope_se": 6, "intercept_se": 4, "slope_t": 4, "r_squared": 8, "adj_r_squared": 8, "log_lik": 2, "aic": 2, "bic": 2}
    return r.select("status", "n", *[F.round(c, d).alias(c) for c, d in digits.items()])


# ---------------------------------------------------------------- profiles


_PROFILE = """WITH t AS (SELECT o_orderkey AS order_id, o_totalprice AS total_cost, o_orderdate AS order_date, o_orderstatus AS status, (o_orderkey % 360) - 180 AS lon, o_totalprice AS population,
    CAST(o_custkey AS VARCHAR) AS area_ft2, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS code, 'Customer ' || o_custkey AS note FROM orders)"""


@query(
    "profile_columns",
    _PROFILE
    + """ SELECT 'order_id' AS name, 'numeric' AS inferred_type, 'unique_identifier' AS inferred_unit_tag, 0::BIGINT AS null_count, count(DISTINCT order_id) AS unique_values FROM t
    UNION ALL SELECT 'total_cost', 'currency', 'USD', 0, count(DISTINCT total_cost) FROM t UNION ALL SELECT 'order_date', 'datetime', 'temporal', 0, count(DISTINCT order_date) FROM t
    UNION ALL SELECT 'status', 'categorical', 'label_lookup', 0, count(DISTINCT status) FROM t UNION ALL SELECT 'lon', 'float', 'decimal_degrees', 0, count(DISTINCT lon) FROM t
    UNION ALL SELECT 'population', 'numeric', NULL, 0, count(DISTINCT population) FROM t UNION ALL SELECT 'area_ft2', 'numeric', 'ft2', 0, count(DISTINCT area_ft2) FROM t
    UNION ALL SELECT 'code', 'numeric', NULL, count(*) FILTER (code = ''), count(DISTINCT nullif(code, '')) FROM t UNION ALL SELECT 'note', 'string', NULL, 0, count(DISTINCT note) FROM t""",
)
def profile_columns(spark, sf_dir):
    return profiling.profile(_profiled(spark, sf_dir))


def _profiled(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("order_id"), F.col("o_totalprice").alias("total_cost"), F.col("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("status"),
        ((key % 360) - 180).alias("lon"), F.col("o_totalprice").alias("population"), F.col("o_custkey").cast("string").alias("area_ft2"),
        F.when(key % 4 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("code"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("note"),
    )


@query(
    "profile_with_descriptions",
    _PROFILE
    + """, p AS (SELECT unnest(['status', 'lon', 'note']) AS name, unnest([count(DISTINCT status), count(DISTINCT lon), count(DISTINCT note)]) AS unique_values FROM t)
    SELECT name, unique_values, CASE name WHEN 'lon' THEN (SELECT min(n_name) FROM nation) WHEN 'status' THEN 'State of the order' ELSE '' END AS human_description FROM p""",
)
def profile_with_descriptions(spark, sf_dir):
    found = profiling.profile(_profiled(spark, sf_dir).select("status", "lon", "note"))
    words = table(spark, sf_dir, "nation").select(F.lit("lon").alias("field_name"), F.col("n_name").alias("description"))
    return joins.describe_columns(found, words, {"status": "State of the order"}).select("name", "unique_values", "human_description")


@query(
    "profile_file_layout",
    _PROFILE
    + """ SELECT 'status' AS "Column Name", 'categorical' AS "Inferred Type", 'label_lookup' AS "Unit/Tag", 0::BIGINT AS "Null Count", count(DISTINCT status) AS "Unique Values", '' AS "Human Description" FROM t
    UNION ALL SELECT 'note', 'string', '', 0, count(DISTINCT note), '' FROM t""",
)
def profile_file_layout(spark, sf_dir):
    return writers.profile_table(profiling.profile(_profiled(spark, sf_dir).select("status", "note")))


@query(
    "matching_column_types",
    """SELECT 'customer' AS source_key, c AS name, 'categorical' AS inferred_type FROM (SELECT unnest(['c_mktsegment', 'c_nationkey']) AS c, unnest([count(DISTINCT c_mktsegment), count(DISTINCT c_nationkey)]) AS d, count(*) AS n FROM customer) WHERE d < 50 AND d / n < 0.1
    UNION ALL SELECT 'orders', c, 'categorical' FROM (SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS c, unnest([count(DISTINCT o_orderstatus), count(DISTINCT o_orderpriority)]) AS d, count(*) AS n FROM orders) WHERE d < 50 AND d / n < 0.1""",
)
def matching_column_types(spark, sf_dir):
    named = {k: table(spark, sf_dir, k) for k in ("customer", "orders")}
    return profiling.find_matching_types(named, ["customer", "orders", "absent"], ["categorical"])


@query("similar_columns")
def similar_columns(spark, sf_dir):
    named = {k: table(spark, sf_dir, k) for k in ("customer", "orders", "part", "supplier")}
    return profiling.type_similarity(named)


@query(
    "entropy_of_priorities",
    """WITH c AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    p AS (SELECT c_mktsegment, n / sum(n) OVER (PARTITION BY c_mktsegment) AS p FROM c) SELECT c_mktsegment, round(-sum(p * ln(p + 1e-9)), 6) AS entropy FROM p GROUP BY c_mktsegment""",
)
def entropy_of_priorities(spark, sf_dir):
    """How evenly the orders of a market segment spread over the priorities."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = orders.groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.groupBy("c_mktsegment").agg(F.collect_list("n").alias("ns"), F.sum("n").alias("all"))
    return shares.select("c_mktsegment", F.round(scalars.entropy(F.transform("ns", lambda n: n / F.col("all"))), 6).alias("entropy"))


# ---------------------------------------------------------------- sampling

_T_TABLE = "CASE WHEN n - 1 > 30 THEN 1.960 ELSE 2.042 END"


@query(
    "confidence_interval_t",
    f"""WITH s AS (SELECT count(value) AS n, avg(value) AS m, stddev_samp(value) / sqrt(count(value)) AS se FROM events)
    SELECT 't_interval' AS method, 0.95::DOUBLE AS confidence, n AS sample_size, round(m, 6) AS estimate, round(se, 6) AS uncertainty, round(m - {_T_TABLE} * se, 6) AS ci_low, round(m + {_T_TABLE} * se, 6) AS ci_high, NULL::VARCHAR AS warning FROM s""",
)
def confidence_interval_t(spark, sf_dir):
    return sampling.confidence_interval(table(spark, sf_dir, "events"), "value")


@query(
    "confidence_interval_z",
    """WITH s AS (SELECT count(value) AS n, avg(value) AS m, stddev_samp(value) / sqrt(count(value)) AS se FROM events)
    SELECT 'z_interval' AS method, 0.99::DOUBLE AS confidence, n AS sample_size, round(m, 6) AS estimate, round(se, 6) AS uncertainty, round(m - 2.576 * se, 6) AS ci_low, round(m + 2.576 * se, 6) AS ci_high, NULL::VARCHAR AS warning FROM s""",
)
def confidence_interval_z(spark, sf_dir):
    return sampling.confidence_interval(table(spark, sf_dir, "events"), "value", 0.99, "z_interval")


@query("confidence_interval_exact_t")
def confidence_interval_exact_t(spark, sf_dir):
    return sampling.confidence_interval(table(spark, sf_dir, "events"), "value", t_mode="exact")


@query(
    "sample_uncertainty",
    """WITH s AS (SELECT event_id, value, row_number() OVER (ORDER BY md5(event_id || ':42'), event_id) - 1 AS p FROM events), k AS (SELECT p, value FROM s WHERE p < 100),
    d AS (SELECT id // 100 AS rep, floor((('0x' || substr(md5(id || ':42'), 1, 8))::BIGINT / 4294967296.0) * 100)::BIGINT AS p FROM range(100000) t(id)),
    b AS (SELECT rep, avg(value) AS m FROM d JOIN k USING (p) GROUP BY rep), o AS (SELECT list_sort(list(m)) AS ms, stddev_samp(m) AS se FROM b), e AS (SELECT count(*) AS n, avg(value) AS m FROM k)
    SELECT 'bootstrap' AS method, 0.95::DOUBLE AS confidence, n AS sample_size, round(m, 6) AS estimate, round(se, 6) AS uncertainty, round(ms[26], 6) AS ci_low, round(ms[976], 6) AS ci_high,
    NULL::VARCHAR AS warning, (SELECT count(*) FROM events) AS population_size FROM o, e""",
)
def sample_uncertainty(spark, sf_dir):
    return sampling.uncertainty(table(spark, sf_dir, "events"), "value", "event_id", 100)


_POISSON = sampling.poisson_weights()
_POISSON_SQL = "CASE " + " ".join(f"WHEN u < {end!r} THEN {i}" for i, end in enumerate(_POISSON)) + f" ELSE {len(_POISSON)} END"


@query(
    "poisson_bootstrap_means",
    f"""WITH r AS (SELECT event_id, value, unnest(range(1000)) AS rep FROM events WHERE value IS NOT NULL), u AS (SELECT value, rep, ('0x' || substr(md5(event_id || ':' || rep || ':42'), 1, 8))::BIGINT / 4294967296.0 AS u FROM r),
    w AS (SELECT rep, value, {_POISSON_SQL} AS w FROM u) SELECT rep, round(sum(w * value) / sum(w) * 1.000000000001, 6) AS m FROM w GROUP BY rep""",
)
def poisson_bootstrap_means(spark, sf_dir):
    means = sampling.poisson_bootstrap_means(table(spark, sf_dir, "events"), "value", "event_id")
    # off the halves, on which engines may round either way
    return rounded(means.withColumn("m", F.col("m") * 1.000000000001), 6, "m")


@query(
    "bootstrap_interval",
    f"""WITH g AS (SELECT floor((('0x' || substr(md5(event_id || ':42'), 1, 8))::BIGINT / 4294967296.0) * {sampling.GROUPS})::BIGINT AS g, sum(value) AS v, count(value) AS c FROM events WHERE value IS NOT NULL GROUP BY 1),
    r AS (SELECT g, v, c, unnest(range(1000)) AS rep FROM g), u AS (SELECT v, c, rep, ('0x' || substr(md5(g || ':' || rep || ':42'), 1, 8))::BIGINT / 4294967296.0 AS u FROM r),
    w AS (SELECT rep, v, c, {_POISSON_SQL} AS w FROM u), m AS (SELECT rep, sum(w * v) / sum(w * c) AS m FROM w GROUP BY rep),
    o AS (SELECT list_sort(list(m)) AS ms, stddev_samp(m) AS se FROM m), e AS (SELECT count(value) AS n, avg(value) AS m FROM events)
    SELECT 'bootstrap' AS method, 0.95::DOUBLE AS confidence, n AS sample_size, round(m, 6) AS estimate, round(se, 6) AS uncertainty, round(ms[26], 6) AS ci_low, round(ms[976], 6) AS ci_high, NULL::VARCHAR AS warning FROM o, e""",
)
def bootstrap_interval(spark, sf_dir):
    """Interval of a mean over the whole table from a thousand replicates."""
    return sampling.confidence_interval(table(spark, sf_dir, "events"), "value", method="bootstrap", row_id="event_id")


@query("little_bootstraps_interval")
def little_bootstraps_interval(spark, sf_dir):
    """The same from subsets of about n ** 0.6 rows; its draws are beyond SQL, the tests hold it against theory."""
    return sampling.confidence_interval(table(spark, sf_dir, "events"), "value", method="little_bootstraps", row_id="event_id", n_bootstrap=200)


@query(
    "group_bias",
    """WITH s AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS a, count(*) FILTER (event_type <> 'error') AS b, avg(value) FILTER (event_type = 'error') AS g, avg(value) FILTER (event_type <> 'error') AS r FROM events)
    SELECT n AS population_size, a AS group_n, b AS complement_n, round(g, 6) AS group_mean, round(r, 6) AS complement_mean, round(g - r, 6) AS estimate, round((g - r) / (r + 1e-9), 6) AS bias_score,
    CASE WHEN abs((g - r) / (r + 1e-9)) > 0.2 THEN printf('means differ by more than a fifth: %.3f against %.3f', g, r) END AS warning FROM s""",
)
def group_bias(spark, sf_dir):
    return sampling.bias(table(spark, sf_dir, "events"), "event_type", "==", "error", "value")
