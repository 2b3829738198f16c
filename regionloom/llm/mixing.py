"""Mixing sources to target weights: a sample whose sources have given shares of the words.

Every source gets a target. Complete epochs (all its documents once more) precede a fractional selection: documents get an
exponential key divided by their quality weight (Efraimidis and Spirakis: the smallest keys are a weighted sample without
replacement), are ordered by it within their source, and the first ones whose sizes sum to the rest of the target are taken.

No source is sorted whole. The cut in the order is found by sums over 256 coarse key cells, then over 256 finer ones inside
the cell of the cut, then by the keys of the one finest cell. So a source with a third of all rows costs no single task.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from regionloom.llm.text import WORD
from regionloom.session import stage

SYMBOLS = "[#*$%&|<>!]"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def plain_quality(text: str = "text") -> Column:
    """A quality weight in [0.5, 1]: less for texts with many symbols for their words."""
    symbols = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(SYMBOLS))
    return 1.0 - 0.5 * F.least(F.lit(1.0), symbols / F.greatest(word_count(text), F.lit(1)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: float, share: float) -> DataFrame:
    """Targets of sources (``__source``, ``__source_size``): the total is shared by weight, and what goes beyond
    ``max_epochs`` times a source's size is shared among the others by their weights, until none is above.

    That is min(limit, level * weight) for one level, found where sources are ordered by limit / weight.
    One row a source meets in one task; there are few sources beside documents.
    """
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("__ratio", F.col("__source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    limited = sizes.withColumn("__weight", weight).withColumns(
        {"__limit": F.col("__source_size") * float(max_epochs), "__total": F.sum("__source_size").over(everything) * share}
    )
    limited = limited.withColumn("__ratio", F.col("__limit") / F.col("__weight"))
    level = (F.col("__total") - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))) / (
        F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
    )
    levelled = limited.withColumn("__level", level)
    ordered = Window.orderBy("__ratio", F.col("__source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = F.first(F.when(F.col("__ratio") >= F.col("__level"), F.col("__level")), ignorenulls=True).over(ordered)
    target = F.least(F.col("__limit"), F.coalesce(found, F.lit(float("inf"))) * F.col("__weight"))
    return levelled.withColumn("__target", target).select("__source", "__source_size", "__target")


def keyed(docs: DataFrame, doc_id: str, source: str, size: Column, quality: Column, seed: int) -> DataFrame:
    """Id, source, size, key and key cell of each document."""
    unit = (F.xxhash64(F.lit(seed), F.col(doc_id)).bitwiseAND(F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    narrow = docs.select(
        F.col(doc_id).alias("__id"), F.col(source).alias("__source"), size.alias("__size"), quality.alias("__quality"), unit.alias("__unit")
    )
    key = -F.log("__unit") / F.greatest(F.coalesce(F.col("__quality"), F.lit(1.0)), F.lit(1e-6))
    cell = F.least(F.floor((1.0 - F.exp(-F.col("__key"))) * 65536), F.lit(65535)).cast("int")
    return narrow.withColumn("__key", key).withColumn("__cell", cell).drop("__quality", "__unit")


def _crossing(sized: DataFrame, cell: str) -> DataFrame:
    """The first cell of each source where the running sum reaches ``__rest``, and the sum before it."""
    cells = sized.groupBy("__rank", cell).agg(F.sum("__size").alias("__sum"), F.first("__rest").alias("__rest"))
    running = cells.withColumn("__run", F.sum("__sum").over(Window.partitionBy("__rank").orderBy(cell)))
    reached = running.where((F.col("__run") >= F.col("__rest")) & (F.col("__rest") > 0))
    return reached.groupBy("__rank").agg(
        F.min_by(F.struct(F.col(cell).alias("cell"), (F.col("__run") - F.col("__sum")).alias("before")), cell).alias("__x")
    ).select("__rank", F.col("__x.cell").alias(cell), F.col("__x.before").alias("__before"))


def mixture(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    quality: Column | None = None,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 17,
) -> DataFrame:
    """How much of each document a mixture takes: id, ``size``, ``source_size``, ``target`` (of its source), ``taken`` (words,
    repeats counted), ``epochs`` (how often the document comes).

    ``weights`` are dealt to the sources in code point order, NULL last, repeating. ``share`` of all sizes is taken.
    The fraction ends with the document that brings the sum nearest to the target, so a source misses it by half a
    document at most. Reruns agree: keys depend on the id and the seed.

    NULL and empty texts have size 0 and are never wanted, NULL is a source of its own, rows with the same id are taken
    together, an empty table gives no rows, other columns are not looked at.
    """
    size = word_count() if size is None else size
    quality = plain_quality() if quality is None else quality
    rows = stage(keyed(docs, doc_id, source, size, quality, seed))
    sizes = rows.groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    targets = source_targets(sizes, weights, max_epochs, share)
    epochs = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0)
    plan = (
        targets.withColumn("__epochs", epochs)
        .withColumn("__rest", F.col("__target") - F.col("__epochs") * F.col("__source_size"))
        .withColumn("__rank", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())))
    )
    plan = stage(plan)
    ranked = rows.join(
        plan.select(F.col("__source").alias("__s"), "__rank", "__rest"), F.col("__source").eqNullSafe(F.col("__s"))
    ).drop("__s", "__source").where("__rest > 0").withColumn("__coarse", (F.col("__cell") / 256).cast("int"))
    coarse = stage(_crossing(ranked, "__coarse"))
    inside = ranked.join(coarse, ["__rank", "__coarse"]).withColumn("__rest", F.col("__rest") - F.col("__before")).drop("__before")
    fine = stage(_crossing(inside, "__cell"))
    last = inside.join(fine, ["__rank", "__cell"]).withColumn("__rest", F.col("__rest") - F.col("__before"))
    pair = F.struct(F.col("__key").alias("key"), F.col("__id").alias("id"))
    summed = last.withColumn("__pair", pair)
    summed = summed.withColumns(
        {
            "__run": F.sum("__size").over(Window.partitionBy("__rank").orderBy("__pair")),
            "__peers": F.sum("__size").over(Window.partitionBy("__rank", "__pair")),
        }
    )
    taken = summed.where((F.col("__run") <= F.col("__rest")) | (2 * F.col("__run") - F.col("__peers") < 2 * F.col("__rest")))
    limits = taken.groupBy("__rank").agg(F.max("__pair").alias("__limit"))
    cuts = (
        plan.join(fine.select("__rank", F.col("__cell").alias("__cut")), "__rank", "left")
        .join(limits, "__rank", "left")
        .drop("__rank", "__rest")
        .withColumnRenamed("__source", "__s")
    )
    cuts = stage(cuts)
    chosen = (F.col("__cell") < F.col("__cut")) | ((F.col("__cell") == F.col("__cut")) & (pair <= F.col("__limit")))
    times = F.col("__epochs") + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0)
    joined = rows.join(cuts, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__times", times.cast("int"))
    return joined.select(
        F.col("__id").alias(doc_id),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__times")).alias("taken"),
        F.col("__times").alias("epochs"),
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents of the mixture, each as many times as it comes; columns as before."""
    times = mixture(docs, doc_id, **options).groupBy(F.col(doc_id).alias("__wanted")).agg(F.max("epochs").alias("__times"))
    joined = docs.join(times.where("__times > 0"), F.col(doc_id).eqNullSafe(F.col("__wanted")))
    copies = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return copies.select(*[docs[c] for c in docs.columns])
