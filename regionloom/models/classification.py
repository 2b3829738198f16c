"""Classifiers and their measures."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from regionloom.functions.scalars import entropy
from regionloom.models import kernel, tree
from regionloom.operators.columns import attach, complete_cases, normalize
from regionloom.session import stage


def confusion_matrix(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    return predictions.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count")
    )


def classification_metrics(predictions: DataFrame, label: str, prediction: str, probability: str | None = None) -> DataFrame:
    """One row: n, accuracy, weighted precision, recall and F1 (0 for an empty class), mean entropy if asked.

    The data is counted once into the confusion matrix; the rest is arithmetic on that small table.
    """
    keys = [F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")]
    sums = [F.count(F.lit(1)).cast("double").alias("c")]
    term = entropy(vector_to_array(probability)) if probability else None
    if term is not None:
        sums.append(F.sum(term).alias("h"))
    cells = predictions.groupBy(*keys).agg(*sums)
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("c").alias("support"), F.lit(0.0).alias("said"), F.when(F.col("label") == F.col("prediction"), F.col("c")).otherwise(0.0).alias("hit")),
                F.struct(F.col("prediction").alias("class"), F.lit(0.0).alias("support"), F.col("c").alias("said"), F.lit(0.0).alias("hit")),
            )
        )
    )
    classes = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")])
    p = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0))
    r = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    n = F.sum("support")
    result = classes.agg(
        n.cast("bigint").alias("n"),
        F.round(F.sum("hit") / n, 4).alias("accuracy"),
        F.round(F.sum(F.col("support") * p) / n, 4).alias("precision"),
        F.round(F.sum(F.col("support") * r) / n, 4).alias("recall"),
        F.round(F.sum(F.col("support") * f1) / n, 4).alias("f1"),
    )
    if term is None:
        return result
    return attach(result, cells.agg(F.round(F.sum("h") / F.sum("c"), 4).alias("class_entropy")))


def _prepared(df: DataFrame, features: list[str], target: str):
    rows = complete_cases(df, [*features, target]).withColumn("__label", F.col(target).cast("string"))
    rows = stage(rows)
    indexer = StringIndexer(inputCol="__label", outputCol="__index", stringOrderType="alphabetAsc").fit(rows)
    return indexer, indexer.transform(rows)


def _labelled(predictions: DataFrame, indexer) -> DataFrame:
    names = F.array(*[F.lit(x) for x in indexer.labels])
    return predictions.withColumn("predicted_label", F.get(names, F.col("prediction").cast("int")))


def logistic_regression(df: DataFrame, features: list[str], target: str, max_iter: int = 500):
    """(model, predictions, metrics): multinomial logistic regression with an L2 penalty equal to C = 1."""
    indexer, rows = _prepared(df, features, target)
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    n = rows.count()
    model = LogisticRegression(
        labelCol="__index", maxIter=max_iter, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False
    ).fit(assembled)
    predictions = _labelled(model.transform(assembled), indexer)
    return model, predictions, classification_metrics(predictions, "__label", "predicted_label", "probability")


@dataclass
class SupportVectorModel:
    """Class names and one machine for each pair of classes; the class of a pair's machine with y = 1 comes first."""

    classes: list[str]
    machines: dict[tuple[int, int], kernel.Machine]

    @property
    def gap(self) -> float:
        """Greatest violation of the optimality conditions that is left in any machine."""
        return max((m.gap for m in self.machines.values()), default=0.0)


def svm(df: DataFrame, features: list[str], target: str, c: float = 1.0, gamma: float | None = None, most_passes: int | None = None):
    """(model, predictions, metrics): RBF support vector classifier on standardized features, one machine for each pair of
    classes, solved in the dual (``kernel.machine``), with a logistic step from decision values to probabilities.

    ``gamma`` is one over the number of features unless given. Pairs vote; of equal votes the first class wins.
    """
    indexer, rows = _prepared(df, features, target)
    classes = list(indexer.labels)
    scaled = normalize(rows, features).withColumn("__id", F.monotonically_increasing_id())
    scaled = stage(scaled)
    x = F.array(*[F.col(f) for f in features])
    machines, values = {}, scaled
    for i, j in combinations(range(len(classes)), 2):
        y = F.when(F.col("__index") == i, 1.0).when(F.col("__index") == j, -1.0).otherwise(0.0)
        found = kernel.machine(scaled.select(F.col("__id").alias("id"), x.alias("x"), y.alias("y")), gamma or 1.0 / len(features), c, most_passes=most_passes)
        machines[i, j] = found
        values = values.join(found.rows.select(F.col("id").alias("__id"), found.decision.alias(f"__d_{i}_{j}")), "__id")
    if not machines:  # a single class
        predictions = _labelled(rows.withColumn("prediction", F.lit(0.0)).withColumn("probability", array_to_vector(F.array(F.lit(1.0)))), indexer)
        return SupportVectorModel(classes, {}), predictions, classification_metrics(predictions, "__label", "predicted_label", "probability")
    pairs = list(machines)
    votes = [sum((F.when((F.col(f"__d_{i}_{j}") > 0) == (k == i), 1).otherwise(0) for i, j in pairs if k in (i, j)), F.lit(0)) for k in range(len(classes))]
    values = values.withColumns(
        {"margins": array_to_vector(F.array(*[F.col(f"__d_{i}_{j}") for i, j in pairs])), "__votes": F.array(*votes)}
    )
    values = stage(values.withColumn("prediction", (F.array_position("__votes", F.array_max("__votes")) - 1).cast("double")))
    platt = LogisticRegression(featuresCol="margins", labelCol="__index", maxIter=1000, predictionCol="__p", rawPredictionCol="__r")
    predictions = _labelled(platt.fit(values).transform(values), indexer).drop("__votes", "__id", *[f"__d_{i}_{j}" for i, j in pairs])
    return SupportVectorModel(classes, machines), predictions, classification_metrics(predictions, "__label", "predicted_label", "probability")


def decision_tree(df: DataFrame, features: list[str], target: str, max_depth: int = 6):
    """(model, predictions, metrics): Gini tree of depth 6 that tries every split point (``tree.grow``)."""
    indexer, rows = _prepared(df, features, target)
    model = tree.grow(rows, features, "__index", len(indexer.labels), max_depth)
    predictions = _labelled(model.predicted(rows), indexer)
    return model, predictions, classification_metrics(predictions, "__label", "predicted_label", "probability")


def feature_importances(model: tree.Tree, features: list[str], spark) -> DataFrame:
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.importances, strict=True)], "feature string, importance double")


def naive_bayes(df: DataFrame, features: list[str], target: str):
    """(class_table, predictions, metrics): Gaussian naive Bayes with population variances and a variance floor of
    1e-9 times the largest feature variance.

    Fitting is one grouped aggregate. The class table (one row per class) enters the scoring as a scalar array, so
    scoring is one pass without a join.
    """
    rows = complete_cases(df, [*features, target]).withColumn("__label", F.col(target).cast("string"))
    floor = F.greatest(*[F.var_pop(f) for f in features]) if len(features) > 1 else F.var_pop(features[0])
    base = rows.agg((floor * 1e-9).alias("__eps"), F.count(F.lit(1)).alias("__n"))
    classes = rows.groupBy("__label").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(f) for f in features]).alias("mean"),
        F.array(*[F.var_pop(f) for f in features]).alias("var"),
    )
    table = attach(classes, base).select(
        F.col("__label").alias("label"),
        (F.col("n") / F.col("__n")).alias("prior"),
        "mean",
        F.transform("var", lambda v: v + F.col("__eps")).alias("var"),
    )
    packed = table.agg(F.array_sort(F.collect_list(F.struct("label", "prior", "mean", "var"))).alias("__classes"))
    scored = attach(rows, packed)
    inputs = F.array(*[F.col(f).cast("double") for f in features])

    def log_density(c):
        z = F.zip_with(F.zip_with(inputs, c["mean"], lambda x, m: (x - m) * (x - m)), c["var"], lambda d, v: F.log(v * (2 * math.pi)) + d / v)
        return F.log(c["prior"]) - F.aggregate(z, F.lit(0.0), lambda s, v: s + v) / 2

    scored = scored.withColumn("__scores", F.transform("__classes", log_density))
    top = F.array_max("__scores")
    shifted = F.transform("__scores", lambda s: F.exp(s - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, v: s + v)
    predictions = scored.withColumns(
        {
            "predicted_label": F.get("__classes", (F.array_position("__scores", top) - 1).cast("int"))["label"],
            "probability": array_to_vector(F.transform(shifted, lambda s: s / total)),
        }
    ).drop("__classes", "__scores")
    return table, predictions, classification_metrics(predictions, "__label", "predicted_label", "probability")
