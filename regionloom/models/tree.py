"""Decision trees by exhaustive splits: every boundary between two values of a feature is tried, none is binned.

A tree grows level by level. Rows are added up to class counts of each value of each feature in each open node, which Spark
combines in every task before they travel; the sums are sorted over the cluster, counts are cumulated inside the partitions
and shifted by the totals of the partitions before, so no node or feature is held in one task. Only the best split of each
node comes to the driver, where the tree is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from regionloom.session import stage


@dataclass
class Node:
    counts: list[int]
    feature: int | None = None
    threshold: float | None = None


@dataclass
class Tree:
    """``nodes`` by number; the root is 1, node i has 2 i (values up to the threshold) and 2 i + 1 below it."""

    features: list[str]
    classes: int
    nodes: dict[int, Node] = field(default_factory=dict)

    @property
    def importances(self) -> np.ndarray:
        """Decrease of the Gini impurity by feature, weighted by rows, as shares of the whole."""
        total = np.zeros(len(self.features))
        for number, node in self.nodes.items():
            if node.feature is not None:
                below = [self.nodes[2 * number], self.nodes[2 * number + 1]]
                total[node.feature] += _impurity(node.counts) - sum(_impurity(b.counts) for b in below)
        return total / total.sum() if total.sum() > 0 else total

    def child(self, node: str, open_nodes: list[int]) -> Column:
        """Number of the node that a row goes to from one that was split."""
        return _where_to(F.col(node), {i: self.nodes[i] for i in open_nodes if self.nodes[i].feature is not None}, self.features)

    def leaf(self) -> Column:
        """Number of the leaf of a row."""
        split = {i: n for i, n in self.nodes.items() if n.feature is not None}
        steps = F.sequence(F.lit(1), F.lit(max(self.nodes).bit_length()))
        return F.aggregate(steps, F.lit(1), lambda at, _: _where_to(at, split, self.features))

    def predicted(self, rows: DataFrame) -> DataFrame:
        """Add ``prediction`` (the most frequent class of the leaf, the first of equals) and ``probability``."""
        leaves = {i: n.counts for i, n in self.nodes.items() if n.feature is None}
        shares = F.create_map(*[F.lit(x) if k == 0 else F.array(*[F.lit(c / max(sum(x), 1)) for c in x]) for i, counts in leaves.items() for k, x in ((0, i), (1, counts))])
        best = F.create_map(*[F.lit(x) for i, counts in leaves.items() for x in (i, float(np.argmax(counts)))])
        placed = rows.withColumn("__leaf", self.leaf())
        return placed.withColumns({"prediction": best[F.col("__leaf")], "probability": array_to_vector(shares[F.col("__leaf")])}).drop("__leaf")


def _impurity(counts: list[int]) -> float:
    n = sum(counts)
    return n - sum(c * c for c in counts) / n if n else 0.0


def _where_to(at: Column, split: dict[int, Node], features: list[str]) -> Column:
    if not split:
        return at
    feature = F.create_map(*[F.lit(x) for i, n in split.items() for x in (i, n.feature + 1)])
    threshold = F.create_map(*[F.lit(x) for i, n in split.items() for x in (i, float(n.threshold))])
    value = F.element_at(F.array(*[F.col(f).cast("double") for f in features]), feature[at])
    return F.when(feature[at].isNotNull(), 2 * at + F.when(value <= threshold[at], 0).otherwise(1)).otherwise(at).cast("int")


def _cumulated(classes: int):
    """Running class counts of each node and feature within a sorted partition, and the value that follows."""
    names = [f"c{k}" for k in range(classes)]

    def run(batches):
        part, key, total, held = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            node, feature, value = (batch.column(c).to_numpy() for c in ("node", "feature", "value"))
            counts = np.column_stack([batch.column(c).to_numpy() for c in names])
            starts = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (feature[1:] != feature[:-1])))
            sums = np.cumsum(counts, axis=0)
            base = np.zeros_like(sums)
            for s, e in zip(starts, np.append(starts[1:], len(node)), strict=True):
                carried = total if s == 0 and key == (node[0], feature[0]) else 0
                base[s:e] = carried - (sums[s - 1] if s else 0)
            sums = sums + base
            following = np.append(value[1:], np.nan)
            same = np.append((node[1:] == node[:-1]) & (feature[1:] == feature[:-1]), False)
            following = np.where(same, following, np.nan)
            made = [node, feature, value, following, *sums.T]
            if held is not None:
                if key == (node[0], feature[0]):
                    held[3][-1] = value[0]
                yield packed(part, held)
            key, total, held = (node[-1], feature[-1]), sums[-1], made
        if held is not None:
            yield packed(part, held)

    def packed(part, columns):
        following = pa.array(columns[3], mask=np.isnan(columns[3]))
        arrays = [pa.array(np.full(len(columns[0]), part, np.int32)), *(following if k == 3 else pa.array(c) for k, c in enumerate(columns))]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "node", "feature", "value", "following", *names])

    return run


def best_splits(rows: DataFrame, features: list[str], classes: int) -> list:
    """The best split of each node (``node``, ``feature``, ``threshold``, ``left``: class counts), from ``__node`` and ``__y``.

    The largest decrease of the Gini impurity wins, of equal ones the first feature and the smallest threshold.
    """
    names = [f"c{k}" for k in range(classes)]
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    entries = rows.select("__node", "__y", F.inline(pairs))
    counts = entries.groupBy(F.col("__node").alias("node"), "feature", "value").agg(
        *[F.sum((F.col("__y") == k).cast("long")).alias(n) for k, n in enumerate(names)]
    )
    counts = stage(counts)
    order = ["node", "feature", "value"]
    kinds = "part int, node int, feature int, value double, following double, " + ", ".join(f"{n} long" for n in names)
    running = stage(counts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cumulated(classes), kinds))
    parts = running.groupBy("node", "feature", "part").agg(F.min("value").alias("least"), *[F.max(n).alias(n) for n in names])
    along = Window.partitionBy("node", "feature").orderBy("part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        "node", "feature", "part", F.lead("least").over(along).alias("next"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"b_{n}") for n in names]
    )
    shifts = stage(shifts)
    whole = counts.where("feature = 0").groupBy("node").agg(*[F.sum(n).alias(f"t_{n}") for n in names])
    joined = running.join(shifts, ["node", "feature", "part"]).join(stage(whole), "node")
    joined = joined.withColumn("following", F.coalesce("following", "next")).where("following IS NOT NULL")
    left = [F.col(n) + F.col(f"b_{n}") for n in names]
    right = [F.col(f"t_{n}") - x for n, x in zip(names, left, strict=True)]

    def purity(side: list[Column]) -> Column:
        return sum((c.cast("double") * c for c in side), F.lit(0.0)) / sum(side, F.lit(0))

    middle = F.col("value") / 2 + F.col("following") / 2
    threshold = F.when(middle < F.col("following"), middle).otherwise(F.col("value"))
    scored = joined.select("node", "feature", threshold.alias("threshold"), F.array(*left).alias("left"), (purity(left) + purity(right)).alias("purity"))
    best = F.max_by(F.struct("feature", "threshold", "left"), F.struct("purity", -F.col("feature"), -F.col("threshold")))
    return scored.groupBy("node").agg(best.alias("b")).select("node", "b.*").collect()


def grow(rows: DataFrame, features: list[str], y: str, classes: int, max_depth: int = 6) -> Tree:
    """Grow a tree on rows without missing features; ``y`` is the number of the class.

    A node stays a leaf if it is pure, if no feature has two values in it, or at ``max_depth``.
    """
    tree = Tree(features, classes)
    rows = stage(rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(y).cast("int").alias("__y"), F.lit(1).alias("__node")))
    known = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    tree.nodes[1] = Node([known.get(k, 0) for k in range(classes)])
    open_nodes = [1]
    for _ in range(max_depth):
        open_nodes = [i for i in open_nodes if sum(c > 0 for c in tree.nodes[i].counts) > 1]
        if not open_nodes:
            break
        found = best_splits(rows.where(F.col("__node").isin(open_nodes)), features, classes)
        for r in found:
            node = tree.nodes[r["node"]]
            node.feature, node.threshold = r["feature"], r["threshold"]
            tree.nodes[2 * r["node"]] = Node(list(r["left"]))
            tree.nodes[2 * r["node"] + 1] = Node([t - c for t, c in zip(node.counts, r["left"], strict=True)])
        rows = stage(rows.withColumn("__node", tree.child("__node", open_nodes)))
        open_nodes = [b for r in found for b in (2 * r["node"], 2 * r["node"] + 1)]
    return tree
