"""How filters overlap: what each step of every order of five filters removes, part by part.

The failing documents of a filter are a sorted posting list per part and range of ids. Unions, differences and overlaps of
these lists are merged range by range, by galloping: the entries of the shorter list are looked up in the longer one. Only
the sizes leave a task; they add up over the ranges, and every figure of every order follows from the sizes of the unions.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from regionloom.session import stage

FILTERS = "ABCDE"
#: Longest range of documents whose lists are merged at once.
RANGE_ROWS = 1 << 16

_WORDS = r"[^\x20\x09-\x0D]+"


def galloping_union(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Sorted union of two sorted lists without repeats; the shorter one is searched for in the longer one."""
    if len(short) > len(long):
        short, long = long, short
    if len(short) == 0:
        return long
    places = np.searchsorted(long, short)
    held = places < len(long)
    held[held] = long[places[held]] == short[held]
    return np.insert(long, places[~held], short[~held])


def galloping_overlap(one: np.ndarray, other: np.ndarray) -> int:
    """How many entries two sorted lists have in common."""
    short, long = (one, other) if len(one) <= len(other) else (other, one)
    places = np.searchsorted(long, short)
    held = places < len(long)
    return int(np.count_nonzero(long[places[held]] == short[held]))


def union_sizes(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each set of filters (a number whose bits name them): entries of the union, and how many are good or toxic."""
    unions, sizes = {0: np.zeros(0, np.int64)}, np.zeros((1 << len(lists), 3), np.int64)
    for s in range(1, 1 << len(lists)):
        top = s.bit_length() - 1
        unions[s] = galloping_union(unions[s ^ (1 << top)], lists[top])
        sizes[s] = len(unions[s]), galloping_overlap(unions[s], good), galloping_overlap(unions[s], toxic)
    return sizes


def _failing(text: Column) -> list[Column]:
    """The conditions A to D; E needs the other documents."""
    words = F.regexp_extract_all(text, F.lit(_WORDS), 0)
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    return [
        n_words < 200,
        100 * n_distinct.cast("long") < 50 * n_words,
        100 * F.size(F.regexp_extract_all(text, F.lit("[A-Z]"), 0)).cast("long") > 3 * F.char_length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def marked(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``__id``, ``__part``, ``__fails`` (bit k: filter k of ``FILTERS``), ``__good`` and ``__toxic`` for each row."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(_failing(content))), F.lit(0))
    rows = docs.select(
        F.col(doc_id).alias("__id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("__part"),
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("__text"),
        bits.alias("__bits"),
    )
    rows = stage(rows)
    # what a text's smallest id is, is combined in each task before it travels; only texts of several ids come back
    first = rows.groupBy("__text").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last")
    marks = labels.groupBy(F.col(doc_id).alias("__label_of")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("__good"), F.max((F.col("toxic") == 1).cast("int")).alias("__toxic")
    )
    joined = rows.join(first, "__text", "left").join(marks, F.col("__id") == F.col("__label_of"), "left")
    copied = F.coalesce(F.col("__id") > F.col("__first"), F.lit(False))
    return joined.select(
        "__id",
        "__part",
        (F.col("__bits") + F.when(copied, 1 << 4).otherwise(0)).cast("int").alias("__fails"),
        F.coalesce("__good", F.lit(0)).alias("__good"),
        F.coalesce("__toxic", F.lit(0)).alias("__toxic"),
    )


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_STEPS = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def _sizes_of_ranges(batches):
    """Sizes of the unions of each stretch of a part; entries are places in the stretch, in the order of ids."""

    def merged(part: str, rows: list[pa.RecordBatch]):
        fails, good, toxic = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("__fails", "__good", "__toxic"))
        lists = [np.flatnonzero(fails >> k & 1) for k in range(len(FILTERS))]
        sizes = union_sizes(lists, np.flatnonzero(good), np.flatnonzero(toxic))
        sizes[0, 0] = len(fails)
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(sizes)), pa.array(range(len(sizes)), pa.int32()), *(pa.array(sizes[:, k]) for k in range(3))],
            names=["part", "filters", "n", "good", "toxic"],
        )

    held, held_part, n = [], None, 0
    for batch in batches:
        codes = batch.column("__part").dictionary_encode()
        index = codes.indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(index)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            part = codes.dictionary[int(index[a])].as_py()
            if held and (part != held_part or n + b - a > RANGE_ROWS):
                yield merged(held_part, held)
                held, n = [], 0
            held.append(batch.slice(a, b - a))
            held_part, n = part, n + b - a
    if held:
        yield merged(held_part, held)


def _steps_of_part(sizes: pd.DataFrame) -> pd.DataFrame:
    """The 600 steps of a part from its 32 union sizes; the entry of no filter has the number of documents."""
    table = np.zeros((1 << len(FILTERS), 3), np.int64)
    table[sizes["filters"].to_numpy()] = sizes[["n", "good", "toxic"]].to_numpy()
    documents, table[0] = table[0, 0], 0
    n, everything = table[:, 0], (1 << len(FILTERS)) - 1
    rows, shapley = [], dict.fromkeys(range(len(FILTERS)), 0)
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            own, after = 1 << k, before | 1 << k
            removed, good, toxic = table[after] - table[before]
            unique = n[everything] - n[everything ^ own]
            rows.append(["".join(FILTERS[x] for x in order), step, k, documents - n[after], removed, n[own] - removed, unique, good, toxic])
            shapley[k] += removed
            before = after
    steps = pd.DataFrame(rows, columns=["filter_order", "step", "filter", *_COUNTS[:-1]])
    steps["shapley"] = steps["filter"].map(shapley)
    return steps.assign(part=sizes["part"].iloc[0])[["part", "filter_order", "step", *_COUNTS]]


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, with the counts of the step.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (failing its filter, but removed before), ``unique_fails``
    (failing its filter alone), ``good_lost`` and ``toxic_lost`` among the removed, and ``shapley`` (what its filter
    removes, summed over all orders). A NULL text is empty, a NULL part is the empty string. Every row counts, repeated
    rows too: rows of one id and text are no copies of each other. A row without an id fails E never and makes no other
    fail it. A document is good (toxic) if a label of its id says so. Other columns are not looked at; no rows give none.
    """
    rows = stage(marked(docs, labels, doc_id, text, part))
    ranged = rows.repartitionByRange("__part", "__id").sortWithinPartitions("__part", "__id").select("__part", "__fails", "__good", "__toxic")
    sizes = ranged.mapInArrow(_sizes_of_ranges, "part string, filters int, n long, good long, toxic long")
    totals = sizes.groupBy("part", "filters").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    return totals.groupBy("part").applyInPandas(_steps_of_part, _STEPS)
