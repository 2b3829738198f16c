"""Dropping lines that recur across documents, by templates of a fixed-depth tree (as log parsers build it).

A line's words with digits are variable fields (``<*>``). The tree's first level is the number of words, the next three are the
leading words. In a leaf, a position is constant if more than half of the leaf's distinct lines have the same word there.
Lines that have all constant words of their leaf share its template, if enough positions behind the leading words (which
make the leaf) are constant and one of these is text, no field; any other line is its own template. A line of one or two
words, or of fields alone, is an exact template: only the same words are the same line. A template in
``min_docs`` or more documents recurs: its lines stay in the document with the smallest id and are dropped from all others.

Lines are numbers until a leaf has several of them; a leaf, a word or a template with a third of all lines is counted by
partial sums. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from regionloom.session import stage

DEPTH = 3
SIMILARITY = 0.7
MIN_DOCS = 2
FIELD = "<*>"
# fixed values: white space of words
_BLANK = r"[\x20\x09-\x0D]+"
_UNEVEN = r"[\x09-\x0D]|\x20\x20"
_NUMBERED = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def spaced(line: Column) -> Column:
    """Words with one space between them."""
    # the replacements here and below are slow and most lines need neither
    return F.trim(F.when(line.rlike(_UNEVEN), F.regexp_replace(line, _BLANK, " ")).otherwise(line))


def masked(line: Column) -> Column:
    """Words with one space between them, those with digits as fields."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(spaced(line), _NUMBERED, FIELD)).otherwise(spaced(line))


def _keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("id"), whole.alias("text")).withColumn("digest", F.xxhash64("text"))


def _parsed() -> dict[str, Column]:
    """Number of words, leaf of the tree (NULL for exact templates) and hash of the columns ``masked`` and ``content``."""
    words = F.split(F.col("masked"), " ")
    exact = (F.size(words) < DEPTH) | (F.trim(F.replace(F.col("masked"), F.lit(FIELD), F.lit(""))) == "")
    return {
        "n": F.when(F.col("masked") == "", 0).otherwise(F.size(words)),
        "leaf": F.when(~exact, F.md5(F.concat_ws(" ", F.size(words).cast("string"), F.slice(words, 1, DEPTH)))),
        # no line has a newline, so exact hashes are of texts that no masked line has
        "own": F.md5(F.when(exact, F.concat(F.lit("\n"), spaced(F.col("content")))).otherwise(F.col("masked"))),
    }


def line_templates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Lines with their templates: ``id``, ``digest`` (of the text), ``line`` (number), ``template``. Lines without words have
    none."""
    rows = _keys(docs, doc_id, text)
    lines = rows.select("id", "digest", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    lines = lines.withColumn("masked", masked(F.col("content"))).withColumns(_parsed())
    # filtered when they are read again: a filter before would work out the words twice
    lines = stage(lines.select("id", "digest", "line", "n", F.unhex("leaf").alias("leaf"), F.unhex("own").alias("own")))
    lines = lines.where("n > 0").drop("n")
    several = lines.where("leaf IS NOT NULL").groupBy("leaf").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("leaf")
    # one place of each distinct line of such leaves, to read its words there
    places = lines.join(several, "leaf").groupBy("own").agg(F.min(F.struct("id", "digest", "line")).alias("p"))
    wanted = places.groupBy(F.col("p.id").alias("__id"), F.col("p.digest").alias("__digest")).agg(F.collect_list("p.line").alias("wanted"))
    found = rows.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")))
    # rows that are equal in id and text have the same lines
    content = found.select(F.split("text", "\n").alias("all"), F.explode("wanted").alias("line"))
    read = content.select(F.element_at("all", F.col("line") + 1).alias("content"))
    read = read.withColumn("masked", masked(F.col("content"))).withColumns(_parsed())
    read = read.select(F.unhex("leaf").alias("leaf"), F.unhex("own").alias("own"), F.split("masked", " ").alias("words")).dropDuplicates(["own"])
    read = stage(read)
    sizes = read.groupBy("leaf").agg(F.count("*").alias("size"))
    words = read.select("leaf", F.posexplode("words").alias("place", "word")).groupBy("leaf", "place", "word").agg(F.count("*").alias("n"))
    constant = words.join(sizes, "leaf").where(2 * F.col("n") > F.col("size")).groupBy("leaf").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("place", "word")))).alias("constant")
    )
    fits = F.forall(F.map_entries("constant"), lambda e: F.element_at("words", e["key"] + 1) == e["value"])
    behind = F.filter(F.map_entries("constant"), lambda e: e["key"] >= DEPTH)
    enough = (F.size(behind) >= similarity * (F.size("words") - DEPTH)) & F.exists(behind, lambda e: e["value"] != FIELD)
    shared = F.unhex(F.md5(F.concat(F.lit("leaf "), F.hex("leaf"))))
    assigned = read.join(constant, "leaf").where(fits & enough).select("own", shared.alias("shared"))
    return lines.join(assigned, "own", "left").select("id", "digest", "line", F.coalesce("shared", "own").alias("template"))


def dropped_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``__id``, ``__digest`` and ``__dropped`` (line numbers from 0 on) of the texts that lose lines."""
    lines = stage(line_templates(docs, doc_id, text, similarity))
    in_docs = lines.select("template", "id").distinct()
    counts = in_docs.groupBy("template").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    recurring = counts.where(F.col("n") >= min_docs).select("template", "first")
    gone = lines.join(recurring, "template").where(~F.col("id").eqNullSafe(F.col("first")))
    return gone.groupBy(F.col("id").alias("__id"), F.col("digest").alias("__digest")).agg(F.collect_set("line").alias("__dropped"))


def without_recurring_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``docs`` without the lines of recurring templates, and ``__n_lines``, ``__n_dropped``.

    Lines without words always stay. Texts that lose nothing are as they were (NULL stays NULL); one that loses all is
    empty. Rows with equal ids are one document to the counts. Documents with a NULL id are one document too, after
    all others. An empty table gives no rows; columns other than the id and the text pass through.
    """
    gone = dropped_lines(docs, doc_id, text, min_docs, similarity)
    digest = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    keyed = docs.withColumn("__key", digest)
    joined = keyed.join(gone, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__digest")), "left")
    lines = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped")), lambda i: F.get(F.col("__lines"), i))
    joined = joined.withColumn("__lines", F.when(F.col("__dropped").isNotNull(), lines))
    joined = joined.withColumn("__kept", F.when(F.col("__dropped").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text)))
    return joined.select(
        *[F.col("__kept").alias(c) if c == text else keyed[c] for c in docs.columns],
        F.size(lines).cast("long").alias("__n_lines"),
        F.coalesce(F.array_size("__dropped"), F.lit(0)).cast("long").alias("__n_dropped"),
    )
