"""License scans: overlapping windows of documents against license templates, by MinHash bands and exact containment.

A template's windows are as long as twice its size class (a power of two of its five-word shingles) and start every size class,
so a template lies wholly in one of them and makes up a quarter of it or more. One MinHash value is a band; ``BANDS`` of them
miss such a window with probability 0.75 ** BANDS, 1 in 10,000. What the bands retrieve is verified: the share of the
template's shingles that the window has. A document or a window without any shingle of any template cannot hold one, so it is
left out before bands are made. Licenses have several templates each; where two differ in a few words only, a match has to
hold the words that tell them apart. Identifier tags, which are too short for shingles, are read by a pattern. Only
DataFrame functions are used.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from regionloom.llm.license_texts import NESTED, TEMPLATES, Template
from regionloom.session import stage

SHINGLE = 5
BANDS = 32
CONTAINED = 0.8
WORDS = r"[\p{L}\p{N}]+"

#: Tag of a license identifier, or of several joined by OR, AND or WITH.
SPDX = "SPDX-License-Identifier:"
_IDENTIFIER = r"[A-Za-z0-9.+-]+"
SPDX_PATTERN = rf"{SPDX}[ \t]*\(?({_IDENTIFIER}(?:\)?[ \t]+(?:OR|AND|WITH)[ \t]+\(?{_IDENTIFIER})*)"


def size_class(template: str) -> int:
    """The power of two at or above the number of shingles."""
    n = max(1, len(re.findall(r"[^\W_]+", template)) - SHINGLE + 1)
    return 1 << (n - 1).bit_length()


def shingle_hashes(text: Column) -> Column:
    """Hashes of all runs of five words, in order; none for a shorter text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORDS})"), F.lit(1))
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - SHINGLE + 1, F.lit(1)))
        each = F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, SHINGLE)))
        return F.when(F.size(h) < SHINGLE, F.array().cast("array<bigint>")).otherwise(each)

    return F.element_at(F.transform(F.array(hashed), runs), 1)


def min_hashes(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda j: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, j))))


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def marked_runs(template: Template) -> list[list[str]]:
    """For each mark of a template, its runs of five words that hold the mark."""
    words = _words(template.text)
    runs = [words[i : i + SHINGLE] for i in range(max(1, len(words) - SHINGLE + 1))]
    return [[" ".join(r) for r in runs if f" {' '.join(_words(mark))} " in f" {' '.join(r)} "] for mark in template.marks]


def template_table(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """``number``, ``license``, ``size_class``, ``template`` (its distinct shingle hashes) and ``required`` (the hashes of which
    a match holds one, for each mark)."""
    kind = "number int, license string, text string, size_class int, runs array<array<string>>"
    rows = [(i, t.license, t.text, size_class(t.text), marked_runs(t)) for i, t in enumerate(templates)]
    table = spark.createDataFrame(rows, kind)
    required = F.transform("runs", lambda mark: F.transform(mark, lambda run: F.element_at(shingle_hashes(run), 1)))
    return table.select("number", "license", "size_class", F.array_distinct(shingle_hashes(F.col("text"))).alias("template"), required.alias("required"))


def _tags(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Identifiers that documents carry as tags; ``first_word`` is that of the first tag."""
    content = F.col(text).cast("string")
    tagged = docs.select(F.col(doc_id).alias("id"), content.alias("text")).where(F.contains("text", F.lit(SPDX)))
    before = F.size(F.regexp_extract_all(F.lower(F.substring_index("text", SPDX, 1)), F.lit(f"({WORDS})"), F.lit(1)))
    each = tagged.select("id", before.cast("long").alias("at"), F.explode(F.regexp_extract_all("text", F.lit(SPDX_PATTERN), F.lit(1))).alias("tag"))
    named = each.select("id", "at", F.explode(F.regexp_extract_all("tag", F.lit(f"({_IDENTIFIER})"), F.lit(1))).alias("license"))
    return named.where(~F.col("license").isin("OR", "AND", "WITH")).select("id", "license", F.lit(1.0).alias("share"), "at")


def license_scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES, contained: float = CONTAINED
) -> DataFrame:
    """One row for each license that a document holds or refers to: id, ``license``, ``containment`` (the best of its
    windows), ``first_word`` (number of the first word, from 0 on), ``n_windows`` (matches of windows and templates, and tags).

    Templates have five words or more. Their shingles, a table of fixed size, are literals of the plan. Of licenses whose
    texts contain each other (``NESTED``) a document has the longest one that it holds. NULL and short texts hold none. Rows
    with equal ids are one document. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates)
    by_class = {r["size_class"]: sorted(r["all"]) for r in known.groupBy("size_class").agg(F.array_distinct(F.flatten(F.collect_list("template"))).alias("all")).collect()}
    every = F.array(*[F.lit(h) for h in sorted({h for hashes in by_class.values() for h in hashes})])
    rows = docs.select(F.col(doc_id).alias("id"), shingle_hashes(F.col(text).cast("string")).alias("shingles"))
    rows = stage(rows.where(F.arrays_overlap("shingles", every)))
    parts = []
    for size, hashes in sorted(by_class.items()):
        dictionary = F.array(*[F.lit(h) for h in hashes])
        mine = rows.where(F.arrays_overlap("shingles", dictionary)).withColumn("start", F.explode(F.sequence(F.lit(0), F.size("shingles") - 1, F.lit(size))))
        window = F.slice("shingles", F.col("start") + 1, 2 * size)
        mine = mine.select("id", F.lit(size).alias("size_class"), "start", window.alias("window"))
        parts.append(mine.where(F.arrays_overlap("window", dictionary)))
    windows = reduce(DataFrame.unionByName, parts)
    bands = windows.select("*", F.posexplode(min_hashes(F.col("window"))).alias("band", "value"))
    sought = known.select("*", F.posexplode(min_hashes(F.col("template"))).alias("band", "value"))
    retrieved = bands.join(sought, ["size_class", "band", "value"]).dropDuplicates(["id", "number", "start"])
    share = F.size(F.array_intersect("window", "template")) / F.size("template")
    told = F.forall("required", lambda runs: F.arrays_overlap("window", runs))
    inside = F.transform("window", lambda h: F.array_contains("template", h))
    at = (F.col("start") + F.array_position(inside, True) - 1).cast("long")
    verified = retrieved.where(told).select("id", "license", share.alias("share"), at.alias("at")).where(F.col("share") >= contained)
    found = verified.unionByName(_tags(docs, doc_id, text)).groupBy("id", "license")
    found = found.agg(F.max("share").alias("containment"), F.min("at").alias("first_word"), F.count("*").alias("n_windows"))
    rank = F.coalesce(*[F.when(F.col("license") == name, i) for i, name in enumerate(NESTED)], F.lit(len(NESTED)))
    nested = F.col("license").isin(*NESTED)
    best = F.max(F.when(nested, rank)).over(Window.partitionBy("id"))
    kept = found.withColumns({"__rank": rank, "__best": best}).where(~nested | (F.col("__rank") == F.col("__best")))
    return kept.drop("__rank", "__best").withColumnRenamed("id", doc_id)
