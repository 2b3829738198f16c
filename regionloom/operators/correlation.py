"""Correlations and the simple regression report."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from regionloom.functions.scalars import known, to_numeric
from regionloom.operators.columns import numeric_columns
from regionloom.operators.tables import hash_order
from regionloom.session import stage


def _pair(a: Column, b: Column) -> Column:
    """Pearson r over the rows where both exist; NULL where it is undefined (``corr`` itself fails on a constant)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    spread = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(spread, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))))


def selected_correlation(df: DataFrame, variables: list[str]) -> DataFrame:
    """(x, y, r) for every pair of the variables in **one** aggregate; a variable needs two values.

    The number of expressions grows with the square of the number of columns, never with the rows.
    """
    values = {v: to_numeric(v) for v in variables}
    pairs = list(combinations(variables, 2))
    wide = df.agg(
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(values.values())],
        *[_pair(values[a], values[b]).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)],
    )
    order = {v: i for i, v in enumerate(variables)}
    cells = []
    for a in variables:
        for b in variables:
            if a == b:
                r = F.lit(1.0)
            else:
                at = pairs.index((a, b)) if (a, b) in pairs else pairs.index((b, a))
                r = F.col(f"r_{at}")
            fit = (F.col(f"n_{order[a]}") > 1) & (F.col(f"n_{order[b]}") > 1)
            cells.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r.alias("r"), fit.alias("fit")))
    return wide.select(F.inline(F.array(*cells))).where("fit").drop("fit")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Square matrix: one row per variable, one column per variable."""
    columns = columns or numeric_columns(df)
    long = selected_correlation(df, columns)
    return long.groupBy(F.col("x").alias("variable")).pivot("y", columns).agg(F.first("r"))


def correlation_weights(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, weight) with the correlation of each feature to the target over complete rows."""
    full = df.dropna(subset=[*features, target])
    wide = full.agg(*[_pair(F.col(c), F.col(target)).alias(c) for c in features])
    return wide.unpivot([], features, "feature", "weight")


def cross_source_correlation(series: dict[str, DataFrame], value: str, row_id: str, n: int = 500) -> DataFrame:
    """r of every pair of sources over independent samples paired by position, cut to the shortest.

    The pairing has no meaning in the data; the result is labelled ``sampled``. ``keyed_cross_correlation``
    aligns on real keys. A source needs five values that differ; fewer than two such sources give no rows. All sources are
    sampled and paired by the same jobs; a sample has at most ``n`` rows.
    """
    parts = [
        df.select(F.lit(key).alias("key"), F.col(row_id).alias("__id"), to_numeric(value).alias("v")) for key, df in series.items()
    ]
    if not parts:
        return SparkSession.active().createDataFrame([], "source_a string, source_b string, r double, pairing string")
    known_values = reduce(DataFrame.unionByName, parts).where("v IS NOT NULL")
    sizes = known_values.groupBy("key").agg(F.count("v").alias("n"), F.stddev_samp("v").alias("s")).where("n >= 5 AND s > 1e-10")
    order = Window.partitionBy("key").orderBy(hash_order("__id"), "__id")
    # the filter on the row number is applied in each task before rows travel
    first = known_values.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n)
    sizes = stage(sizes)
    length = F.least(F.lit(n), F.min("n").over(Window.partitionBy(F.lit(0))))
    sample = stage(first.join(sizes.select("key", length.alias("__length")), "key").where("__r <= __length").select("key", "__r", "v"))
    a = sample.select(F.col("key").alias("source_a"), "__r", F.col("v").alias("va"))
    b = sample.select(F.col("key").alias("source_b"), "__r", F.col("v").alias("vb"))
    names = {key: i for i, key in enumerate(series)}
    place = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    pairs = a.join(b, "__r").where(place[F.col("source_a")] < place[F.col("source_b")])
    r = _pair(F.col("va"), F.col("vb")).alias("r")
    return pairs.groupBy("source_a", "source_b").agg(r).withColumn("pairing", F.lit("sampled"))


def keyed_cross_correlation(obs: DataFrame, keys: list[str], sources: list[str], value: str = "metric_value") -> DataFrame:
    """Means per key and source, then r of every pair of sources over their common keys."""
    wide = obs.groupBy(*keys).pivot("source_key", sources).agg(F.avg(known(value)))
    return selected_correlation(wide, sources).where("x < y")


def cross_domain_compare(obs: DataFrame) -> DataFrame:
    """Rows and mean metric per category and year (choice ours)."""
    return obs.groupBy("dataset_category", "year").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg(known("metric_value")).alias("metric_mean")
    )


def cross_domain_correlation(obs: DataFrame, categories: list[str]) -> DataFrame:
    """r between the yearly means of the categories (choice ours)."""
    wide = obs.groupBy("year").pivot("dataset_category", categories).agg(F.avg(known("metric_value")))
    return selected_correlation(wide, categories).where("x < y")


def matrix_compare(obs: DataFrame) -> DataFrame:
    """Cosine between the vectors (rows, mean, deviation, mean place) of each two sources (choice ours).

    Works on one row per source; the pair step joins these summaries on the order of the source keys.
    """
    vectors = obs.groupBy("source_key").agg(
        F.array(
            F.count(F.lit(1)).cast("double"),
            F.coalesce(F.avg("metric_value"), F.lit(0.0)),
            F.coalesce(F.stddev_samp("metric_value"), F.lit(0.0)),
            F.coalesce(F.avg("latitude"), F.lit(0.0)),
            F.coalesce(F.avg("longitude"), F.lit(0.0)),
        ).alias("v")
    )
    a = vectors.select(F.col("source_key").alias("source_a"), F.col("v").alias("va"))
    b = vectors.select(F.col("source_key").alias("source_b"), F.col("v").alias("vb"))

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, p: acc + p)

    cosine = F.try_divide(dot("va", "vb"), F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb")))
    return a.join(b, F.col("source_a") < F.col("source_b")).select("source_a", "source_b", cosine.alias("cosine"))


def regression_summary(df: DataFrame, x: str = "year", y: str = "metric_value") -> DataFrame:
    """Simple least squares as one row: estimates, standard errors, t values, p values and fit measures.

    All of it follows from six sums. Fewer than two complete rows give status ``failed``. The p values come from
    Student's t by a series of native expressions (see ``student_t_two_sided``).
    """
    xs, ys = to_numeric(x), to_numeric(y)
    sums = df.agg(
        F.regr_count(ys, xs).alias("n"),
        F.regr_avgx(ys, xs).alias("mx"),
        F.regr_avgy(ys, xs).alias("my"),
        F.regr_sxx(ys, xs).alias("sxx"),
        F.regr_syy(ys, xs).alias("syy"),
        F.regr_sxy(ys, xs).alias("sxy"),
    )
    c = F.col
    n = c("n").cast("double")
    step = sums.withColumn("slope", F.try_divide("sxy", "sxx"))
    step = step.withColumn("intercept", c("my") - c("slope") * c("mx"))
    step = step.withColumn("rss", F.greatest(c("syy") - c("slope") * c("sxy"), F.lit(0.0)))
    step = step.withColumn("df_residual", F.greatest(c("n") - 2, F.lit(0)))
    step = step.withColumn("sigma", F.sqrt(F.try_divide(c("rss"), c("df_residual"))))
    step = step.withColumn("slope_se", F.try_divide(c("sigma"), F.sqrt("sxx")))
    step = step.withColumn(
        "intercept_se", c("sigma") * F.sqrt(1 / n + F.try_divide(c("mx") * c("mx"), c("sxx")))
    )
    step = step.withColumns(
        {
            "slope_t": F.try_divide("slope", "slope_se"),
            "intercept_t": F.try_divide("intercept", "intercept_se"),
            "r_squared": 1 - F.try_divide("rss", "syy"),
        }
    )
    step = step.withColumn(
        "adj_r_squared", 1 - (1 - c("r_squared")) * F.try_divide(n - 1, c("df_residual").cast("double"))
    )
    log_lik = -0.5 * n * (F.log(F.lit(2.0) * F.pi()) + F.log(F.when(c("rss") > 0, c("rss")) / n) + 1)
    step = step.withColumns({"f_statistic": c("slope_t") * c("slope_t"), "log_lik": log_lik})
    step = step.withColumns({"aic": 6.0 - 2 * c("log_lik"), "bic": 3 * F.log(n) - 2 * c("log_lik")})
    step = step.withColumns(
        {
            "slope_p": student_t_two_sided(c("slope_t"), c("df_residual").cast("double")),
            "intercept_p": student_t_two_sided(c("intercept_t"), c("df_residual").cast("double")),
            "status": F.when(c("n") >= 2, "success").otherwise("failed"),
        }
    )
    return step.select(
        "status", "n", "intercept", "intercept_se", "intercept_t", "intercept_p", "slope", "slope_se", "slope_t", "slope_p",
        "r_squared", "adj_r_squared", "sigma", "f_statistic", "log_lik", "aic", "bic", "df_residual",
    )


def student_t_two_sided(t: Column, df: Column, panels: int = 400) -> Column:
    """P(|T| > |t|): Simpson's rule over the angle u with t = sqrt(df) tan(u), where the density is cos(u)^(df-1).

    For many degrees of freedom the mass sits near u = 0, so the far end of the integral is cut there.
    """
    start = F.atan(F.abs(t) / F.sqrt(df))
    reach = F.least(F.lit(1.5707963267948966), F.lit(14.0) / F.sqrt(F.greatest(df - 1, F.lit(1.0))))
    reach = F.when(df <= 100, F.lit(1.5707963267948966)).otherwise(reach)

    def integral(a: Column) -> Column:
        h = (reach - a) / panels
        terms = F.transform(
            F.sequence(F.lit(0), F.lit(panels)),
            lambda i: F.when((i == 0) | (i == panels), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            * F.pow(F.greatest(F.cos(a + i * h), F.lit(0.0)), df - 1),
        )
        return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v) * h / 3

    tail = F.when(start < reach, integral(start)).otherwise(F.lit(0.0))
    return F.when(t.isNotNull() & (df >= 1), tail / integral(F.lit(0.0)))
