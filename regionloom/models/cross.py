"""Models per cluster over pairs of variable groups."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from regionloom.models.classification import svm
from regionloom.operators.columns import complete_cases
from regionloom.session import stage


def linear_by_group(df: DataFrame, by: str, features: list[str], target: str) -> DataFrame:
    """(by, n, r2, coef, intercept) per group from sums of products: one aggregate for all groups."""
    rows = complete_cases(df, [*features, target])
    names = [*features, target]
    sums = [F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    means = [F.avg(a).alias(f"m_{i}") for i, a in enumerate(names)]
    table = rows.groupBy(F.col(by).alias("key")).agg(F.count(F.lit(1)).alias("n"), *means, *sums)
    width = len(features)

    def solve(batches):
        for batch in batches:
            out = []
            for _, r in batch.iterrows():
                lhs = np.array([[r[f"c_{min(i, j)}_{max(i, j)}"] for j in range(width)] for i in range(width)], dtype=float)
                rhs = np.array([r[f"c_{i}_{width}"] for i in range(width)], dtype=float)
                coef = np.linalg.lstsq(lhs, rhs, rcond=None)[0]
                spread = float(r[f"c_{width}_{width}"])
                r2 = float(coef @ rhs / spread) if spread > 0 else None
                shift = float(r[f"m_{width}"] - coef @ np.array([r[f"m_{i}"] for i in range(width)], dtype=float))
                out.append((r["key"], int(r["n"]), r2, coef.tolist(), shift))
            yield pd.DataFrame(out, columns=["key", "n", "r2", "coef", "intercept"])

    kind = dict(table.dtypes)["key"]
    solved = table.mapInPandas(solve, f"key {kind}, n bigint, r2 double, coef array<double>, intercept double")
    return solved.withColumnRenamed("key", by)


def _marked(df: DataFrame, by: str, features: list[str], targets: list[str]) -> DataFrame:
    """A row per row and target: ``key``, ``target``, ``x`` (the features) and whether the target is above its mean in the key."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets])
    x = F.array(*[F.col(f).cast("double") for f in features])
    long = df.select(F.col(by).alias("key"), x.alias("x"), F.inline(pairs)).where(F.col("y").isNotNull())
    means = long.groupBy(F.col("key").alias("k"), F.col("target").alias("t")).agg(F.avg("y").alias("mean"))
    joined = long.join(means, F.col("key").eqNullSafe(F.col("k")) & (F.col("target") == F.col("t")))
    complete = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)) & ~F.isnan("y")
    return joined.where(complete).select("key", "target", "x", F.when(F.col("y") > F.col("mean"), "above").otherwise("below").alias("label"))


def _with(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows beside what a small table has for their key and target."""
    named = table.withColumnsRenamed({"key": "__key", "target": "__target"})
    return rows.join(named, F.col("key").eqNullSafe(F.col("__key")) & (F.col("target") == F.col("__target"))).drop("__key", "__target")


def _accuracy(predicted: DataFrame) -> DataFrame:
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    return predicted.groupBy("key", "target").agg(F.count(F.lit(1)).alias("n"), F.round(right, 4).alias("score"))


def naive_bayes_by_group(rows: DataFrame, width: int) -> DataFrame:
    """(key, target, n, score): accuracy of Gaussian naive Bayes for every key and target, all fitted by one aggregate."""
    each = [F.get("x", F.lit(i)) for i in range(width)]
    classes = rows.groupBy("key", "target", "label").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(v) for v in each]).alias("mean"), F.array(*[F.var_pop(v) for v in each]).alias("var")
    )
    floor = rows.groupBy("key", "target").agg((F.array_max(F.array(*[F.var_pop(v) for v in each])) * 1e-9).alias("eps"), F.count(F.lit(1)).alias("total"))
    packed = classes.groupBy("key", "target").agg(F.array_sort(F.collect_list(F.struct("label", "n", "mean", "var"))).alias("classes"))
    table = stage(_with(packed, floor))

    def density(c):
        z = F.zip_with(F.zip_with("x", c["mean"], lambda x, m: (x - m) * (x - m)), c["var"], lambda d, v: F.log((v + F.col("eps")) * (2 * math.pi)) + d / (v + F.col("eps")))
        return F.log(c["n"] / F.col("total")) - F.aggregate(z, F.lit(0.0), lambda s, v: s + v) / 2

    scored = _with(rows, table).withColumn("scores", F.transform("classes", density))
    best = F.coalesce(F.array_position("scores", F.array_max("scores")).cast("int"), F.lit(1))
    return _accuracy(scored.withColumn("prediction", F.element_at("classes", best)["label"]))


def logistic_by_group(rows: DataFrame, width: int, most_steps: int = 25) -> DataFrame:
    """(key, target, n, score): accuracy of logistic regression with an L2 penalty (C = 1) for every key and target.

    Newton's steps of all fits run together: a step is one aggregate, and small systems solved in one row each.
    """
    kind = dict(rows.dtypes)["key"]
    full = rows.select("key", "target", "label", F.concat(F.array(F.lit(1.0)), F.col("x")).alias("x"), (F.col("label") == "above").cast("double").alias("y"))
    full = stage(full)
    fits = full.groupBy("key", "target").agg(F.array_repeat(F.lit(0.0), width + 1).alias("beta"))
    fits = stage(fits.withColumn("moved", F.lit(1.0)))

    def solve(batches):
        for batch in batches:
            betas, moves = [], []
            for _, r in batch.iterrows():
                beta = np.array(r["beta"], float)
                lhs = np.array([[r[f"h_{min(i, j)}_{max(i, j)}"] for j in range(width + 1)] for i in range(width + 1)], float)
                rhs = np.array([r[f"g_{i}"] for i in range(width + 1)], float)
                penalty = np.append(0.0, np.ones(width))
                step = np.linalg.lstsq(lhs + np.diag(penalty + 1e-12), rhs - penalty * beta, rcond=None)[0]
                step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
                betas.append((beta + step).tolist())
                moves.append(float(np.abs(step).max()))
            yield pd.DataFrame({"key": batch["key"], "target": batch["target"], "beta": betas, "moved": moves})

    z = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    for _ in range(most_steps):
        p = 1 / (1 + F.exp(-z))
        steps = _with(full, fits).withColumn("p", p)
        weight = F.col("p") * (1 - F.col("p"))
        at = [F.get("x", F.lit(i)) for i in range(width + 1)]
        sums = [F.sum(weight * at[i] * at[j]).alias(f"h_{i}_{j}") for i in range(width + 1) for j in range(i, width + 1)]
        sums += [F.sum((F.col("y") - F.col("p")) * at[i]).alias(f"g_{i}") for i in range(width + 1)]
        system = steps.groupBy("key", "target").agg(F.first("beta").alias("beta"), *sums)
        fits = stage(system.mapInPandas(solve, f"key {kind}, target string, beta array<double>, moved double"))
        if (fits.agg(F.max("moved")).first()[0] or 0.0) < 1e-7:
            break
    return _accuracy(_with(full, fits).withColumn("prediction", F.when(z > 0, "above").otherwise("below")))


_BY_GROUP = {"naive_bayes": naive_bayes_by_group, "logistic_regression": logistic_by_group}


def cross_analysis(df: DataFrame, by: str, groups: dict[str, list[str]], models: list[str]) -> DataFrame:
    """(by, from_group, target, model, n, score) for every ordered pair of variable groups (choice ours).

    The features of one group explain each column of another. Linear models give r2; classifiers predict whether the
    target lies above its mean in the cluster and give accuracy. ``linear_regression``, ``naive_bayes`` and
    ``logistic_regression`` are fitted for all clusters (the last two for all targets too) by the same aggregates; ``svm``
    has no such form and is fitted for one cluster after the other, whose number is k.
    """
    unknown = set(models) - {"linear_regression", "svm", *_BY_GROUP}
    if unknown:
        raise ValueError(f"unknown models: {sorted(unknown)}")
    parts = []

    def add(fit: DataFrame, a: str, target, model: str) -> None:
        parts.append(fit.select(by, F.lit(a).alias("from_group"), target.alias("target"), F.lit(model).alias("model"), "n", "score"))

    for a, b in [(a, b) for a in groups for b in groups if a != b]:
        marked = None
        for model in models:
            if model == "linear_regression":
                for target in groups[b]:
                    add(linear_by_group(df, by, groups[a], target).select(by, "n", F.round("r2", 4).alias("score")), a, F.lit(target), model)
                continue
            marked = marked or stage(_marked(df, by, groups[a], groups[b]))
            if model in _BY_GROUP:
                found = _BY_GROUP[model](marked, len(groups[a]))
                add(found.withColumnRenamed("key", by), a, F.col("target"), model)
                continue
            wide = marked.select("key", "target", "label", *[F.get("x", F.lit(i)).alias(f) for i, f in enumerate(groups[a])])
            for r in marked.select("key", "target").distinct().orderBy("key", "target").collect():  # k clusters times the targets
                rows = wide.where(F.col("key").eqNullSafe(F.lit(r["key"])) & (F.col("target") == r["target"]))
                _, _, metrics = svm(rows, groups[a], "label")
                add(metrics.select(F.lit(r["key"]).alias(by), "n", F.col("accuracy").alias("score")), a, F.lit(r["target"]), model)
    return reduce(DataFrame.unionByName, parts)
