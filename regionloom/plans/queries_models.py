"""Models."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionloom.models import classification, clustering, cross, decomposition, regression, series
from regionloom.operators.columns import normalize
from regionloom.plans.registry import query
from regionloom.plans.views import EV, events, table

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_FEATURES, "l_returnflag", "l_linestatus")


_OLS = """WITH t AS (SELECT l_quantity AS x, l_discount AS z, l_extendedprice AS y FROM lineitem), c AS (SELECT count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, var_pop(y) AS yy,
    covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM t), b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM c),
    i AS (SELECT *, my - bx * mx - bz * mz AS b0 FROM b)"""


@query(
    "linear_regression_metrics",
    _OLS
    + """, e AS (SELECT y - b0 - bx * x - bz * z AS e, yy, n FROM t, i) SELECT count(*) AS n, round(1 - sum(e * e) / (any_value(yy) * count(*) + 1e-9), 4) AS r2, round(avg(abs(e)), 2) AS mae, round(avg(e * e), 0) AS mse,
    round(sqrt(avg(e * e)), 2) AS rmse, round(stddev_pop(e), 2) AS residual_std, round(2 * sqrt(avg(e * e)), 2) AS prediction_interval FROM e""",
)
def linear_regression_metrics(spark, sf_dir):
    _, _, metrics = regression.linear_regression(lineitem(spark, sf_dir), ["l_quantity", "l_discount"], "l_extendedprice")
    digits = {"r2": 4, "mae": 2, "mse": 0, "rmse": 2, "residual_std": 2, "prediction_interval": 2}
    return metrics.select("n", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("linear_regression_coefficients", _OLS + " SELECT unnest(['intercept', 'l_quantity', 'l_discount']) AS term, round(unnest([b0, bx, bz]), 3) AS estimate FROM i")
def linear_regression_coefficients(spark, sf_dir):
    names = ["l_quantity", "l_discount"]
    model, _, _ = regression.linear_regression(lineitem(spark, sf_dir), names, "l_extendedprice")
    return regression.coefficients(model, names, spark).withColumn("estimate", F.round("estimate", 3))


_NB = """WITH t AS (SELECT row_number() OVER () AS id, l_quantity AS a, l_extendedprice AS b, l_linestatus AS k FROM lineitem), e AS (SELECT greatest(var_pop(a), var_pop(b)) * 1e-9 AS eps, count(*) AS n FROM t),
    c AS (SELECT k, ln(count(*)::DOUBLE / any_value(n)) AS p, avg(a) AS ma, avg(b) AS mb, var_pop(a) + any_value(eps) AS va, var_pop(b) + any_value(eps) AS vb FROM t, e GROUP BY k),
    s AS (SELECT id, t.k AS label, c.k AS guess, p - 0.5 * (ln(2 * pi() * va) + (a - ma)**2 / va + ln(2 * pi() * vb) + (b - mb)**2 / vb) AS s FROM t, c),
    m AS (SELECT id, label, arg_max(guess, s) AS prediction FROM s GROUP BY id, label)"""


@query("naive_bayes_confusion", _NB + " SELECT label, prediction, count(*) AS \"count\" FROM m GROUP BY ALL")
def naive_bayes_confusion(spark, sf_dir):
    _, predictions, _ = classification.naive_bayes(lineitem(spark, sf_dir), ["l_quantity", "l_extendedprice"], "l_linestatus")
    return classification.confusion_matrix(predictions, "l_linestatus", "predicted_label")


@query("naive_bayes_metrics", _NB + " SELECT count(*) AS n, round(avg((label = prediction)::INT), 4) AS accuracy FROM m")
def naive_bayes_metrics(spark, sf_dir):
    _, _, metrics = classification.naive_bayes(lineitem(spark, sf_dir), ["l_quantity", "l_extendedprice"], "l_linestatus")
    return metrics.select("n", "accuracy")


@query(
    "classification_measures",
    """WITH p AS (SELECT l_returnflag AS y, CASE WHEN l_linestatus = 'F' AND l_quantity > 25 THEN 'A' WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END AS h FROM lineitem), k AS (SELECT DISTINCT y AS k FROM p),
    c AS (SELECT k, count(*) FILTER (y = k) AS s, count(*) FILTER (h = k) AS said, count(*) FILTER (y = k AND h = k) AS hit FROM k, p GROUP BY k), r AS (SELECT s, hit, hit / said AS p, hit / s AS r FROM c)
    SELECT sum(s)::BIGINT AS n, round(sum(hit) / sum(s), 4) AS accuracy, round(sum(s * p) / sum(s), 4) AS precision, round(sum(s * r) / sum(s), 4) AS recall, round(sum(s * 2 * p * r / (p + r)) / sum(s), 4) AS f1 FROM r""",
)
def classification_measures(spark, sf_dir):
    late = F.col("l_linestatus") == "F"
    p = lineitem(spark, sf_dir).withColumn("guess", F.when(late & (F.col("l_quantity") > 25), "A").when(late, "R").otherwise("N"))
    return classification.classification_metrics(p, "l_returnflag", "guess")


@query("logistic_regression_metrics")
def logistic_regression_metrics(spark, sf_dir):
    _, _, metrics = classification.logistic_regression(lineitem(spark, sf_dir), _FEATURES, "l_returnflag")
    return metrics


@query("svm_metrics")
def svm_metrics(spark, sf_dir):
    _, _, metrics = classification.svm(lineitem(spark, sf_dir), _FEATURES, "l_linestatus")
    return metrics


@query("decision_tree_metrics")
def decision_tree_metrics(spark, sf_dir):
    _, _, metrics = classification.decision_tree(lineitem(spark, sf_dir), _FEATURES, "l_returnflag")
    return metrics


@query("decision_tree_importances")
def decision_tree_importances(spark, sf_dir):
    model, _, _ = classification.decision_tree(lineitem(spark, sf_dir), _FEATURES, "l_returnflag")
    return classification.feature_importances(model, _FEATURES, spark)


@query(
    "decision_tree_root",
    """WITH v AS (SELECT 0 AS f, l_quantity AS v, l_returnflag AS y FROM lineitem UNION ALL SELECT 1, l_extendedprice, l_returnflag FROM lineitem UNION ALL SELECT 2, l_discount, l_returnflag FROM lineitem UNION ALL SELECT 3, l_tax, l_returnflag FROM lineitem),
    c AS (SELECT f, v, count(*) FILTER (y = 'A') AS a, count(*) FILTER (y = 'N') AS n, count(*) FILTER (y = 'R') AS r FROM v GROUP BY f, v),
    s AS (SELECT f, v, lead(v) OVER w AS next, sum(a) OVER w AS a, sum(n) OVER w AS n, sum(r) OVER w AS r, sum(a) OVER p AS ta, sum(n) OVER p AS tn, sum(r) OVER p AS tr FROM c WINDOW w AS (PARTITION BY f ORDER BY v), p AS (PARTITION BY f)),
    g AS (SELECT *, (a::DOUBLE * a + n::DOUBLE * n + r::DOUBLE * r) / (a + n + r) + ((ta - a)::DOUBLE * (ta - a) + (tn - n)::DOUBLE * (tn - n) + (tr - r)::DOUBLE * (tr - r)) / (ta - a + tn - n + tr - r) AS purity FROM s WHERE next IS NOT NULL),
    b AS (SELECT * FROM g ORDER BY purity DESC, f, v LIMIT 1)
    SELECT ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'][f + 1] AS feature, round(v / 2 + next / 2, 6) AS threshold, (a + n + r)::BIGINT AS n_left, (ta - a + tn - n + tr - r)::BIGINT AS n_right FROM b""",
)
def decision_tree_root(spark, sf_dir):
    """The best of all split points of all rows."""
    model, _, _ = classification.decision_tree(lineitem(spark, sf_dir), _FEATURES, "l_returnflag", max_depth=1)
    root, sides = model.nodes[1], [sum(model.nodes[i].counts) for i in (2, 3)]
    # one row: the split was found by passes over the table
    return lineitem(spark, sf_dir).limit(1).select(
        F.lit(_FEATURES[root.feature]).alias("feature"), F.lit(round(root.threshold, 6)).alias("threshold"), *[F.lit(n).cast("long").alias(f"n_{s}") for n, s in zip(sides, ("left", "right"))]
    )


@query(
    "pca_explained",
    """WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem) SELECT unnest([1, 2])::INTEGER AS component, round(unnest([(1 + r) / 2, (1 - r) / 2]), 4) AS explained_ratio, 1.0::DOUBLE AS total_explained, 0.0::DOUBLE AS reconstruction_mse FROM r""",
)
def pca_explained(spark, sf_dir):
    _, _, _, metrics = decomposition.pca(lineitem(spark, sf_dir), ["l_quantity", "l_extendedprice"], 2)
    return metrics


@query("pca_first_component", "SELECT 1::INTEGER AS component, unnest(['l_quantity', 'l_extendedprice']) AS column, 0.7071::DOUBLE AS loading FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r IS NOT NULL")
def pca_first_component(spark, sf_dir):
    _, _, loadings, _ = decomposition.pca(lineitem(spark, sf_dir), ["l_quantity", "l_extendedprice"], 1)
    # of two columns both loadings are equal in size, so the sign rule has a tie
    return loadings.withColumn("loading", F.abs("loading"))


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    """Size and profile of six clusters of events in space and time."""
    ev = events(spark, sf_dir).withColumn("seconds", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double"))
    names = ["latitude", "longitude", "seconds"]
    found = clustering.kmeans(ev, names, 6, keep=["event_id"])
    profiles = clustering.cluster_profiles(found.labels, names, found.k)
    return profiles.withColumns({"inertia": F.lit(round(found.inertia, 4)), "silhouette": F.lit(round(found.silhouette, 4))})


# any six places in the standardized space will do
_CENTRES = [[-0.8, -0.8, -0.5], [-0.8, 0.8, 0.5], [0.0, 0.0, -1.0], [0.0, 0.0, 1.0], [0.8, -0.8, 0.5], [0.8, 0.8, -0.5]]
_CENTRE_ROWS = ", ".join(f"({j}, {', '.join(f'{v}::DOUBLE' for v in c)})" for j, c in enumerate(_CENTRES))


@query(
    "kmeans_assignment",
    f"""WITH {EV}, v AS (SELECT event_id, latitude AS a, longitude AS b, epoch(ts)::BIGINT::DOUBLE AS c FROM ev),
    z AS (SELECT event_id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b, (c - avg(c) OVER ()) / stddev_pop(c) OVER () AS c FROM v),
    k(cluster, x, y, w) AS (VALUES {_CENTRE_ROWS}), d AS (SELECT event_id, a, b, c, cluster, (a - x)**2 + (b - y)**2 + (c - w)**2 AS square FROM z, k),
    n AS (SELECT event_id, arg_min(cluster, square) AS cluster, min(square) AS square FROM d GROUP BY event_id)
    SELECT cluster::INTEGER AS cluster, count(*) AS n, round(sum(square), 2) AS inertia FROM n GROUP BY cluster""",
)
def kmeans_assignment(spark, sf_dir):
    """Rows and inertia of each of six given centres: the step that k-means repeats."""
    # whole seconds, the nearest ones, as the SQL casts them
    ev = events(spark, sf_dir).withColumn("seconds", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6))
    names = ["latitude", "longitude", "seconds"]
    found = clustering.assigned(normalize(ev, names), names, _CENTRES)
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("__square"), 2).alias("inertia"))


@query(
    "cluster_profiles",
    "WITH k AS (SELECT range AS cluster FROM range(7)) SELECT cluster, count(l_quantity) AS n, round(avg(l_quantity), 4) AS l_quantity_mean, round(avg(l_discount), 4) AS l_discount_mean FROM k LEFT JOIN lineitem ON l_linenumber % 6 = cluster GROUP BY cluster",
)
def cluster_profiles(spark, sf_dir):
    labels = table(spark, sf_dir, "lineitem").withColumn("cluster", F.col("l_linenumber") % 6)
    return clustering.cluster_profiles(labels, ["l_quantity", "l_discount"], 7)


_HOURLY = "s AS (SELECT event_type AS source_key, date_trunc('hour', ts) AS hour, avg(value) AS y FROM events GROUP BY ALL), n AS (SELECT source_key, y, row_number() OVER (PARTITION BY source_key ORDER BY hour) - 1 AS i, count(*) OVER (PARTITION BY source_key) AS n FROM s)"


def hourly(spark, sf_dir):
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return events(spark, sf_dir).groupBy("source_key", hour.alias("hour")).agg(F.avg("value").alias("y"))


def _dft(source: str) -> str:
    return f"""WITH {source}, f AS (SELECT source_key, n, k, sum(y * cos(2 * pi() * ((i * k) % n) / n)) AS re, sum(y * sin(2 * pi() * ((i * k) % n) / n)) AS im FROM n, range(100000) t(k) WHERE k <= n // 2 GROUP BY ALL),
    a AS (SELECT source_key, n, k, sqrt(re * re + im * im) AS a FROM f), e AS (SELECT *, sum(a * a) OVER (PARTITION BY source_key) AS e, count(*) OVER (PARTITION BY source_key) AS b, row_number() OVER (PARTITION BY source_key ORDER BY a DESC) AS r FROM a)
    SELECT source_key, r::INTEGER AS rank, round(k / n, 6) AS frequency, round(a, 4) AS amplitude, n AS n_samples, b AS n_bins, round(e, 2) AS spectral_energy, round(1.0 / n, 6)::DOUBLE AS frequency_uncertainty FROM e WHERE r <= 5"""


@query("fourier_by_source", _dft(_HOURLY))
def fourier_by_source(spark, sf_dir):
    return series.fourier(hourly(spark, sf_dir), "source_key", "hour", "y").drop("phase")


@query(
    "fourier_of_long_series",
    _dft("n AS (SELECT event_type AS source_key, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)"),
)
def fourier_of_long_series(spark, sf_dir):
    """The transform in pieces, forced by a low limit for whole series."""
    return series.fourier(events(spark, sf_dir), "source_key", "event_id", "value", longest=512).drop("phase")


@query(
    "arima_110",
    f"""WITH {_HOURLY}, d AS (SELECT source_key, i, y - lag(y) OVER w AS w FROM n WINDOW w AS (PARTITION BY source_key ORDER BY i)), l AS (SELECT source_key, w, lag(w) OVER (PARTITION BY source_key ORDER BY i) AS w1 FROM d),
    p AS (SELECT source_key, sum(w * w1) / sum(w1 * w1) AS phi FROM l WHERE w IS NOT NULL AND w1 IS NOT NULL GROUP BY source_key), u AS (SELECT l.source_key, w - phi * w1 AS u, phi FROM l JOIN p USING (source_key) WHERE w1 IS NOT NULL)
    SELECT source_key, count(*) AS n, round(any_value(phi), 6) AS phi, round(count(*) * (ln(2 * pi() * avg(u * u)) + 1) + 4, 2) AS aic, round(count(*) * (ln(2 * pi() * avg(u * u)) + 1) + 2 * ln(count(*)), 2) AS bic, round(sqrt(avg(u * u)), 4) AS rmse FROM u GROUP BY source_key""",
)
def arima_110(spark, sf_dir):
    fits, _ = series.arima(hourly(spark, sf_dir), "source_key", "hour", "y", order=(1, 1, 0), block=256, method="two_step")
    return fits.select("source_key", "n", F.round(F.get("coef", F.lit(0)), 6).alias("phi"), "aic", "bic", "rmse")


@query(
    "arima_exact_110",
    f"""WITH RECURSIVE {_HOURLY}, d AS (SELECT source_key, i, y - lag(y) OVER w AS w FROM n WINDOW w AS (PARTITION BY source_key ORDER BY i)), l AS (SELECT source_key, w, lag(w) OVER (PARTITION BY source_key ORDER BY i) AS v FROM d WHERE w IS NOT NULL),
    c AS (SELECT source_key, count(*) AS n, sum(w * w) FILTER (v IS NOT NULL) AS a, sum(w * v) AS b, sum(v * v) AS e, sum(w * w) FILTER (v IS NULL) AS f FROM l GROUP BY source_key),
    h(source_key, low, high, step) AS (SELECT source_key, -0.999999::DOUBLE, 0.999999::DOUBLE, 0 FROM c UNION ALL
      SELECT source_key, CASE WHEN n * 2 * (m * (e - f) - b) / (f + a - 2 * m * b + m * m * (e - f)) + 2 * m / (1 - m * m) < 0 THEN m ELSE low END,
        CASE WHEN n * 2 * (m * (e - f) - b) / (f + a - 2 * m * b + m * m * (e - f)) + 2 * m / (1 - m * m) < 0 THEN high ELSE m END, step + 1
      FROM (SELECT h.*, c.* EXCLUDE source_key, (low + high) / 2 AS m FROM h JOIN c USING (source_key) WHERE step < 60)),
    r AS (SELECT source_key, n, low AS phi, (f + a - 2 * low * b + low * low * (e - f)) / n AS s FROM h JOIN c USING (source_key) WHERE step = 60)
    SELECT source_key, n, round(phi, 4) AS phi, round(n * (ln(2 * pi() * s) + 1) - ln(1 - phi * phi) + 4, 2) AS aic, round(n * (ln(2 * pi() * s) + 1) - ln(1 - phi * phi) + 2 * ln(n), 2) AS bic, round(sqrt(s), 4) AS rmse FROM r""",
)
def arima_exact_110(spark, sf_dir):
    """The exact likelihood, filtered in blocks of 256 hours; of one coefficient it is a formula that SQL can bisect."""
    fits, _ = series.arima(hourly(spark, sf_dir), "source_key", "hour", "y", order=(1, 1, 0), block=256)
    return fits.select("source_key", "n", F.round(F.get("coef", F.lit(0)), 4).alias("phi"), "aic", "bic", "rmse")


@query("arima_forecasts")
def arima_forecasts(spark, sf_dir):
    _, forecasts = series.arima(hourly(spark, sf_dir), "source_key", "hour", "y", order=(1, 1, 1), steps=10)
    return forecasts


@query(
    "cross_analysis_linear",
    """WITH c AS (SELECT l_linestatus AS cluster, count(*) AS n, regr_r2(l_discount, l_quantity) AS a, regr_r2(l_tax, l_quantity) AS b FROM lineitem GROUP BY 1)
    SELECT cluster, 'size' AS from_group, unnest(['l_discount', 'l_tax']) AS target, 'linear_regression' AS model, n, round(unnest([a, b]), 4) AS score FROM c
    UNION ALL SELECT cluster, 'money', 'l_quantity', 'linear_regression', n, round((p * p + q * q - 2 * p * q * s) / (1 - s * s), 4) FROM (SELECT l_linestatus AS cluster, count(*) AS n,
    corr(l_quantity, l_discount) AS p, corr(l_quantity, l_tax) AS q, corr(l_discount, l_tax) AS s FROM lineitem GROUP BY 1)""",
)
def cross_analysis_linear(spark, sf_dir):
    rows = lineitem(spark, sf_dir).withColumnRenamed("l_linestatus", "cluster")
    return cross.cross_analysis(rows, "cluster", {"size": ["l_quantity"], "money": ["l_discount", "l_tax"]}, ["linear_regression"])


@query("cross_analysis_by_cluster")
def cross_analysis_by_cluster(spark, sf_dir):
    """Clusters of events, then linear and Bayes models between groups of variables in each cluster."""
    ev = events(spark, sf_dir).withColumn("k", F.from_json("props", "k double")["k"])
    found = clustering.kmeans(ev, ["latitude", "longitude", "value", "k"], 3)
    return cross.cross_analysis(found.labels, "cluster", {"place": ["latitude", "longitude"], "size": ["value"]}, ["linear_regression", "naive_bayes"])
