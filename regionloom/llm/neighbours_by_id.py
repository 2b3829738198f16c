"""The document that follows each one by id, without ordering all texts in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from regionloom.session import stage

FINE = 128
MOST_RANGES = FINE * FINE
ROWS_IN_RANGE = 1024


def _bucket(doc_id: Column, cuts: list) -> Column:
    """The number of cuts at or below an id; cuts are grouped, so that a row looks at about twice their square root."""
    if not cuts:
        return F.lit(0)
    groups = [cuts[i : i + FINE] for i in range(0, len(cuts), FINE)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    group = F.greatest(F.size(F.filter(heads, lambda x: x <= doc_id)), F.lit(1))
    inner = F.element_at(F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups]), group)
    return ((group - 1) * FINE + F.size(F.filter(inner, lambda x: x <= doc_id))).cast("int")


def in_ranges(docs: DataFrame, doc_id: str) -> tuple[DataFrame, WindowSpec]:
    """``docs`` dealt out by ranges of ids, and a window in which ``F.lead`` finds the row with the next larger id (after
    the last one: the first of all).

    Ids are cut at their quantiles into ranges of about ``ROWS_IN_RANGE`` rows, ``MOST_RANGES`` at most, so the cuts and the
    ranges' first rows are few. The rows travel once. A copy of the first row of the following range joins each range as
    a guest: drop the rows where ``__guest`` is true after use. NULL ids come first; equal ids are ordered by a hash of the row.
    """
    ranges = max(1, min(docs.count() // ROWS_IN_RANGE, MOST_RANGES))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx(doc_id, shares, 10 * ranges)).first()[0] if shares else None
    cuts = sorted(set(cuts or []))
    bucket = _bucket(F.col(doc_id), cuts)
    firsts = docs.select(bucket.alias("__bucket"), doc_id).groupBy("__bucket").agg(F.min(doc_id).alias("__first"))
    following = Window.orderBy("__bucket")
    everything = following.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follower = F.coalesce(F.lead("__first").over(following), F.first("__first").over(everything))
    after = stage(firsts.select(F.col("__bucket").alias("__before"), follower.alias("__after")))
    guests = docs.join(F.broadcast(after), F.col(doc_id).eqNullSafe(F.col("__after"))).drop("__after")
    own = docs.withColumns({"__bucket": bucket, "__guest": F.lit(False)})
    dealt = own.unionByName(guests.withColumnRenamed("__before", "__bucket").withColumn("__guest", F.lit(True)))
    dealt = dealt.withColumn("__tie", F.xxhash64(*docs.columns))
    return dealt.repartition("__bucket"), Window.partitionBy("__bucket").orderBy("__guest", doc_id, "__tie")
