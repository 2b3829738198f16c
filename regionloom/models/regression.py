"""Linear regression fitted by Spark ML, with in-sample measures."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from regionloom.operators.columns import complete_cases


def linear_regression(df: DataFrame, features: list[str], target: str):
    """(model, predictions, metrics): least squares over complete rows by the normal equations.

    metrics is one row: r2, mae, mse, rmse, residual_std (population), prediction_interval (2 rmse).
    """
    rows = complete_cases(df, [*features, target])
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    model = LinearRegression(labelCol=target, solver="normal", regParam=0.0).fit(assembled)
    predictions = model.transform(assembled)
    return model, predictions, regression_metrics(predictions, target, "prediction")


def regression_metrics(predictions: DataFrame, target: str, prediction: str) -> DataFrame:
    e = F.col(target) - F.col(prediction)
    sums = predictions.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("ssr"),
        (F.var_pop(target) * F.count(F.lit(1))).alias("sst"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.stddev_pop(e).alias("residual_std"),
    )
    return sums.select(
        "n",
        F.round(1 - F.col("ssr") / (F.col("sst") + 1e-9), 4).alias("r2"),
        F.round("mae", 4).alias("mae"),
        F.round("mse", 4).alias("mse"),
        F.round(F.sqrt("mse"), 4).alias("rmse"),
        F.round("residual_std", 4).alias("residual_std"),
        F.round(2 * F.sqrt("mse"), 4).alias("prediction_interval"),
    )


def coefficients(model, features: list[str], spark) -> DataFrame:
    """(term, estimate) of a fitted model: one row per feature, the driver already holds them."""
    rows = [("intercept", float(model.intercept)), *[(f, float(c)) for f, c in zip(features, model.coefficients)]]
    return spark.createDataFrame(rows, "term string, estimate double")

