"""Near duplicates by ProbMinHash signatures, banding, exact verification and connected components.

Signatures. Every distinct shingle of a text is a Poisson process whose rate is its weight; each arrival picks one of the
registers at random, and a register keeps the shingle that arrived first. A shingle's process ends once its next arrival is
later than the latest register of its text. Two texts agree in a register with their probability Jaccard similarity. All
weights are 1, however often a shingle stands in the text: the links are decided by plain sets, whose Jaccard similarity is
then what the signatures estimate.

Links. Equal texts are one vertex. A band of registers is a bucket. In each bucket all members are compared with one
leader, the one with the most company in all its buckets. That joins whole groups of near copies without listing their
pairs. Only members of a bucket that are still in different classes are then compared with each other; large buckets in
blocks, each by products of incidence matrices, which give links that join classes, not pairs. So of the pairs that share a
bucket no link between different classes is left out, and no list of pairs is longer than its groups. Agreement of the
signatures prunes the other pairs; the shingle sets decide (Jaccard ``similarity`` or more). Signatures are random: a pair
just at the threshold shares no bucket about 3 times in a million, and is pruned about 2 times in 100,000.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regionloom.llm.components import components
from regionloom.llm.text import Rolling, Texts, by_slices, mixed, runs, within
from regionloom.session import stage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND = 24, 4
REGISTERS = BANDS * BAND
# agreement of signatures below which a pair is not worth a comparison: more than four standard errors below the threshold
PRUNE = 0.62
FEW = 16
BLOCK = 512


def shingles(texts: Texts, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their rows and counts, ordered by row. A text of fewer words is one shingle."""
    starts, ends = texts.words()
    rows = texts.owner(starts)
    hashes = Rolling(texts.data).of(starts, ends)
    found, at = runs(hashes, rows, width)
    of = rows[at]
    n_words = np.bincount(rows, minlength=texts.n)
    for row in np.flatnonzero((n_words > 0) & (n_words < width)):
        a, b = np.searchsorted(rows, [row, row + 1])
        whole = np.uint64(b - a)
        for h in hashes[a:b]:
            whole = mixed(np.array([whole], np.uint64))[0] ^ h
        found, of = np.append(found, whole), np.append(of, row)
    keys = within(found, of)
    order = np.lexsort((keys, of))
    first = np.append(True, keys[order][1:] != keys[order][:-1]) if len(order) else np.zeros(0, bool)
    counts = np.diff(np.append(np.flatnonzero(first), len(order)))
    return found[order][first], of[order][first], counts


def signatures(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """One row of registers (32 bits each) for each text; zeros for a text without shingles."""
    earliest = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, np.uint32)
    time = np.zeros(len(hashes))
    which = np.arange(len(hashes))
    turn = 0
    while len(which):
        h = mixed(hashes[which] + np.uint64((turn * 0x9E3779B97F4A7C15) % (1 << 64)))
        time[which] -= np.log1p(-(h >> np.uint64(11)).astype(float) / (1 << 53)) / weights[which]
        latest = earliest.reshape(n, registers).max(axis=1) if n else np.zeros(0)
        which, h = which[alive := time[which] < latest[rows[which]]], h[alive]
        at = rows[which] * registers + (mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, at, time[which])
        won = time[which] == earliest[at]
        kept[at[won]] = (mixed(hashes[which[won]]) >> np.uint64(32)).astype(np.uint32)
        turn += 1
    return kept.reshape(n, registers)


def band_hashes(kept: np.ndarray, bands: int = BANDS) -> np.ndarray:
    wide = kept.reshape(len(kept), bands, -1).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), wide.shape[:2]).copy()
    for k in range(wide.shape[2]):
        total = mixed(total + wide[:, :, k])
    return total.view(np.int64)


def _signed(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
    hashes, rows, _ = shingles(texts)
    # the weights of plain sets, by which the links are decided
    kept = signatures(hashes, rows, np.ones(len(hashes)), texts.n)
    some = np.bincount(rows, minlength=texts.n) > 0
    bands = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32()), pa.array(band_hashes(kept)[some].ravel(), pa.int64())
    )
    signature = pa.array([x.tobytes() for x in kept], pa.binary())
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), bands, signature], names=["id", "v", "bands", "signature"])


def _agreeing(batches):
    for batch in batches:
        a, b = (
            np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, REGISTERS) for i in (2, 3)
        )
        agree = (a == b).mean(axis=1) >= PRUNE
        yield batch.select(["a", "b"]).filter(pa.array(agree))


def jaccard(left: Texts, right: Texts) -> np.ndarray:
    """Similarity of the shingle sets of texts side by side; 1 for two texts without words."""
    a, a_rows, _ = shingles(left)
    b, b_rows, _ = shingles(right)
    keys = np.sort(np.concatenate([within(a, a_rows), within(b, b_rows)]))
    shared = keys[1:][keys[1:] == keys[:-1]]
    order = np.argsort(within(a, a_rows))
    both = np.bincount(a_rows[order][np.searchsorted(within(a, a_rows)[order], shared)], minlength=left.n)
    total = np.bincount(a_rows, minlength=left.n) + np.bincount(b_rows, minlength=left.n) - both
    return np.where(total > 0, both / np.maximum(total, 1), 1.0)


def _verified(pairs: DataFrame, texts: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose shingle sets are similar; signatures prune them first."""
    marks = signed.select("v", "signature")
    beside = pairs.join(marks.toDF("a", "__sa"), "a").join(marks.toDF("b", "__sb"), "b").select("a", "b", "__sa", "__sb")
    likely = stage(beside.mapInArrow(_agreeing, "a binary, b binary"))
    both = likely.join(texts.toDF("a", "__ta"), "a").join(texts.toDF("b", "__tb"), "b").select("a", "b", "__ta", "__tb")

    def compare(part: pa.RecordBatch, left: Texts) -> pa.RecordBatch:
        similar = jaccard(left, Texts(part.column(3))) >= similarity
        return part.select(["a", "b"]).filter(pa.array(similar))

    return stage(by_slices(both, "__ta", compare, "a binary, b binary"))


def _sets(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
    hashes, rows, _ = shingles(texts)
    cuts = np.searchsorted(rows, np.arange(texts.n + 1))
    blobs = [np.sort(hashes[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], names=["v", "shingles"])


def _shared(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right: products of their incidence matrices,
    over the shingles that both sides have, some columns at a time."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (left, right)]
    both = np.intersect1d(sides[0][0], sides[1][0])
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(both), columns):
        some = both[at : at + columns]
        matrices = []
        for (hashes, row), n in zip(sides, (len(left), len(right)), strict=True):
            place = np.minimum(np.searchsorted(some, hashes), len(some) - 1)
            hit = some[place] == hashes
            matrix = np.zeros((n, len(some)), np.float32)
            matrix[row[hit], place[hit]] = 1
            matrices.append(matrix)
        total += matrices[0] @ matrices[1].T
    return total


def _across(similarity: float):
    """Links between the classes of two blocks of a bucket: all similar pairs are found, and those are given that join classes
    not joined before, fewer than there are members."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        one, other = (group[group["side"] == side].reset_index(drop=True) for side in key[1:])
        if one.empty or other.empty:
            return pd.DataFrame({"a": [], "b": []})
        sets = [[np.frombuffer(x, np.uint64) for x in frame["shingles"]] for frame in (one, other)]
        both = _shared(*sets)
        sizes = [np.array([len(x) for x in side], np.float32) for side in sets]
        numbers = {r: k for k, r in enumerate(dict.fromkeys([*one["root"], *other["root"]]))}
        classes = [np.array([numbers[r] for r in frame["root"]]) for frame in (one, other)]
        similar = both >= similarity * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-3
        similar &= (both > 0) & (classes[0][:, None] != classes[1][None, :])
        top = list(range(len(numbers)))

        def root(k):
            while top[k] != k:
                top[k] = k = top[top[k]]
            return k

        found = []
        for i, j in zip(*np.nonzero(similar), strict=True):
            a, b = root(classes[0][i]), root(classes[1][j])
            if a != b:
                top[a] = b
                found.append((one["v"][i], other["v"][j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _remaining(members: DataFrame, roots: DataFrame, signed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between members of one bucket that are in different classes, but for those with the bucket's leader."""
    classed = members.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    mixed_buckets = classed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"))
    mixed_buckets = mixed_buckets.where("x <> y").select("bucket")
    rest = classed.where("n > 2 AND v <> leader").join(mixed_buckets, "bucket").select("bucket", "n", "v", "root")
    rest = stage(rest)
    few = rest.where(F.col("n") <= FEW)
    small = (
        few.select("bucket", F.col("v").alias("a"), F.col("root").alias("x"))
        .join(few.select("bucket", F.col("v").alias("b"), F.col("root").alias("y")), "bucket")
        .where("a < b AND x <> y")
        .select("a", "b")
        .distinct()
    )
    many = rest.where(F.col("n") > FEW)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    needed = texts.join(many.select("v").distinct(), "v", "left_semi")
    sets = stage(by_slices(needed, "text", _sets, "v binary, shingles binary"))
    own = F.pmod(F.xxhash64("v"), blocks).cast("int")
    dealt = many.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "v", "root").join(sets, "v")
    # a block is few bytes and much work, so blocks are dealt out by number, not by size
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "bucket", "i", "j")
    large = stage(dealt.groupBy("bucket", "i", "j").applyInPandas(_across(similarity), "a binary, b binary"))
    return _verified(small, texts, signed, similarity).union(large)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: id, ``class_id`` (the smallest id of its class), ``class_size``, ``kept`` (has the smallest id).

    Classes are the connected components of all pairs of texts whose sets of five-word shingles have a Jaccard similarity
    of ``similarity`` or more; a text of one to four words is one shingle. Equal texts are in one class, so are all texts that
    are NULL or empty; a text of white space alone is equal only to itself. Rows with equal ids and texts are all ``kept``
    if they have the smallest id. An empty table gives no rows; other columns are not read.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), F.unhex(F.md5(whole)).alias("v"), whole.alias("text"))
    kind = dict(rows.dtypes)["id"]
    every = stage(by_slices(rows, "text", _signed, f"id {kind}, v binary, bands array<bigint>, signature binary"))
    distinct = every.groupBy("v").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    signed = stage(distinct)
    spread = signed.select("v", F.explode("bands").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared_buckets = stage(spread.join(sizes, "bucket"))
    support = shared_buckets.groupBy("v").agg(F.sum("n").alias("support"))
    leaders = shared_buckets.join(support, "v").groupBy("bucket").agg(F.max_by("v", F.struct("support", "v")).alias("leader"))
    members = stage(shared_buckets.join(leaders, "bucket"))
    shared = members.select("v").distinct()
    texts = rows.select("v", "text").join(shared, "v", "left_semi").groupBy("v").agg(F.first("text").alias("text"))
    texts = stage(texts)
    stars = members.where("v <> leader").select(F.col("leader").alias("a"), F.col("v").alias("b")).distinct()
    links = _verified(stars, texts, signed, similarity)
    roots = components(links)
    more = _remaining(members, roots, signed, texts, similarity)
    if not more.isEmpty():
        roots = components(links.union(more))
    labelled = every.select("id", "v").join(roots, "v", "left").select("id", F.coalesce("root", "v").alias("root"))
    sizes = labelled.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return labelled.join(sizes, "root").select(
        F.col("id").alias(doc_id), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents with the smallest ids of their classes; columns as before."""
    found = near_duplicates(docs, doc_id, text, similarity)
    dropped = found.where("NOT kept").select(F.col(doc_id).alias("__dropped")).distinct()
    return docs.join(dropped, F.col(doc_id).eqNullSafe(F.col("__dropped")), "left_anti")
