"""From raw documents to a tokenized training set: five stages, each written as Parquet and read by the next.

Every stage takes any table with the columns of documents, others beside them too. A NULL text counts as empty, rows with a
NULL id are one document, repeated rows are rows of their own (but copies of a text leave one id in ``near_duplicates``), and
an empty table gives an empty table. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from regionloom.llm import line_crf, line_templates, mixing, pieces, prob_minhash
from regionloom.session import staging_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, fitted on the labels of the folder, predicts to be good."""
    return line_crf.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates; ``n_chars`` counts what is left."""
    kept = line_templates.without_recurring_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates."""
    return prob_minhash.without_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources; a document comes as often as the mixture takes it."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of each row, how many, and the digest of the text that they decode to."""
    decoded = pieces.decode(pieces.encode(docs))
    digest = F.sha2(F.col("decoded").cast("binary"), 256)
    return decoded.withColumns({"n_pieces": F.size("ids"), "decoded_sha256": digest}).drop("decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", source_mixing),
    ("pieces", encoding),
]

# models and signatures are beyond SQL; the tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{staging_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
