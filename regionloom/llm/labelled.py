"""Bounded samples of labelled documents, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text", where: Column | None = None
) -> DataFrame:
    """At most ``rows`` labelled documents (``__id``, ``__text``, ``__label``), the ones with the smallest hashes of their ids.

    Ids with a NULL or with contradicting labels are left out. The ids alone are ordered; there are ``rows`` of them at
    most, so Spark may broadcast them to the documents. ``where`` is a condition on the column ``__id``.
    """
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label")).dropna()
    if where is not None:
        known = known.where(where)
    known = known.groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__most"))
    chosen = known.where("__label = __most").drop("__most").orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(F.col(doc_id).alias("__key"), F.col(text).cast("string").alias("__text"))
    return texts.join(chosen, F.col("__key") == F.col("__id")).select("__id", "__text", "__label")
