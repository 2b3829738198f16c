"""Principal components of standardized columns."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from regionloom.operators.columns import complete_cases, normalize


def pca(df: DataFrame, columns: list[str], k: int | None = None):
    """(model, projected, loadings, metrics).

    loadings: (component, column, loading), the sign such that the largest loading is positive.
    metrics: (component, explained_ratio, total_explained, reconstruction_mse). On data scaled with the population
    deviation the mean squared error of the reconstruction is the share of variance left out.
    """
    k = min(k or 3, len(columns))
    rows = normalize(complete_cases(df, columns), columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    model = PCA(k=k, inputCol="features", outputCol="components").fit(vectors)
    ratios = [float(v) for v in model.explainedVariance]
    weights = model.pc.toArray()
    spark = df.sparkSession
    loadings = []
    for j in range(k):
        largest = max(range(len(columns)), key=lambda i: abs(weights[i, j]))
        sign = 1.0 if weights[largest, j] >= 0 else -1.0
        loadings += [(j + 1, c, round(float(sign * weights[i, j]), 4)) for i, c in enumerate(columns)]
    spread = vectors.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    varying = sum(1 for c in columns if (spread[c] or 0.0) > 0)
    left_out = max(0.0, 1.0 - sum(ratios)) * varying / len(columns)
    metrics = [(j + 1, round(r, 4), round(sum(ratios), 4), round(left_out, 6)) for j, r in enumerate(ratios)]
    return (
        model,
        model.transform(vectors),
        spark.createDataFrame(loadings, "component int, column string, loading double"),
        spark.createDataFrame(metrics, "component int, explained_ratio double, total_explained double, reconstruction_mse double"),
    )
