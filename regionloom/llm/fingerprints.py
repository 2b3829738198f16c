"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of all hashes is kept.

The kept hashes of a text are a sample of its shingles that does not depend on the text's size. So the sketch of a union is
the union of the sketches, and the share of one text inside another can be estimated however unequal they are.
A shingle is five words; a shorter text is one shingle. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from regionloom.llm.neighbours_by_id import in_ranges
from regionloom.llm.text import WORD

SHINGLE = 5
FRACTION = 0.25


def sketch(text: Column, fraction: float = FRACTION, width: int = SHINGLE) -> Column:
    """Distinct shingle hashes (63 bits, ascending) below ``fraction`` of their range."""
    words = F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.xxhash64(w))
    most = int(fraction * (1 << 63))
    bits = F.lit((1 << 63) - 1)

    def shingles(hashed: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashed) - width + 1, F.lit(1)))
        each = F.transform(starts, lambda i: F.xxhash64(F.slice(hashed, i, width)).bitwiseAND(bits))
        return F.when(F.size(hashed) == 0, F.array().cast("array<bigint>")).otherwise(each)

    # the array of one element binds the word hashes to a variable, so that they are made once, not once a shingle
    kept = F.element_at(F.transform(F.array(words), lambda hashed: F.filter(shingles(hashed), lambda h: h < most)), 1)
    return F.array_sort(F.array_distinct(kept))


def fingerprint(text: Column, kept: Column) -> Column:
    """As text: a hash of the whole text, a colon, the sketch. Equal texts have equal ones."""
    each = F.transform(kept, lambda h: F.lower(F.hex(h)))
    return F.concat_ws(":", F.lower(F.hex(F.xxhash64(text))), F.array_join(each, "."))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Estimated Jaccard likeness of two sketches; 1 where the texts are ``equal``, else 0 where either sketch is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(equal, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; NULL if the sketch of ``a`` is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts together."""
    return F.array_sort(F.array_union(a, b))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Id, ``n_words``, ``sketch`` and ``fingerprint`` of every document.

    NULL is an empty text; an empty text has no shingles, a text of fewer than five words has one. Equal texts get equal
    fingerprints, rows with equal ids stay apart, an empty table gives no rows, other columns are not read.
    """
    whole = docs.select(doc_id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    kept = whole.withColumn("sketch", sketch(F.col("__text"), fraction))
    return kept.select(
        doc_id, F.regexp_count("__text", F.lit(WORD)).alias("n_words"), "sketch", fingerprint(F.col("__text"), F.col("sketch")).alias("fingerprint")
    )


def edits_and_successors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likeness to the edited text and to the next document.

    The edited text has its last quarter (rounded down, code points) replaced by as many of the first of the next document's,
    by ascending id; after the last comes the first. A lone document follows itself. NULL is an empty text.
    """
    whole = docs.select(doc_id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    dealt, order = in_ranges(whole, doc_id)
    kept = dealt.withColumn("__sketch", sketch(F.col("__text"), fraction))
    beside = kept.withColumns({"__next": F.lead("__text").over(order), "__next_sketch": F.lead("__sketch").over(order)}).where(~F.col("__guest"))
    n = F.char_length("__text")
    edited = F.concat(F.substring(F.col("__text"), F.lit(1), n - F.floor(n / 4).cast("int")), F.substring(F.col("__next"), F.lit(1), F.floor(n / 4).cast("int")))
    beside = beside.withColumn("__edited", edited)
    beside = beside.withColumn("__edited_sketch", sketch(F.col("__edited"), fraction))
    return beside.select(
        doc_id,
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("__edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("__text"), F.col("__sketch")).alias("fingerprint"),
        fingerprint(F.col("__edited"), F.col("__edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("__sketch"), F.col("__edited_sketch"), F.col("__text") == F.col("__edited")).alias("near_edited"),
        likeness(F.col("__sketch"), F.col("__next_sketch"), F.col("__text") == F.col("__next")).alias("near_next"),
        containment(F.col("__sketch"), F.col("__edited_sketch")).alias("contained_in_edited"),
        containment(F.col("__sketch"), F.col("__next_sketch")).alias("contained_in_next"),
    )
