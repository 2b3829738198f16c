"""Tries of conversations by turns, from sorted sequences and the lengths of their common prefixes.

A turn is a digest of 16 bytes, a conversation the string of its digests, cut into segments of 256 turns; a segment is filed
under the turns before it (its class), so that no row grows with a conversation. The segments are sorted over the cluster;
next to each stands how many turns it shares with the one before. A prefix is an interval of the sorted rows: a sparse table
of range minima over those numbers lets every prefix find its left and right end by binary search on its own, and all
its figures are sums or minima over the interval. Blocks of rows are searched side by side; only prefixes that reach over the
edge of a block, a few for each block, are put together afterwards.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from regionloom.operators.positions import number_rows
from regionloom.session import stage

SEGMENT = 256
#: Turns of the rows that are searched at once; a row counts for four more.
BLOCK_TURNS = 1 << 18
DIGEST = 16
#: Ids in one piece of a list that is hashed piece by piece.
PIECE = 1024
_CLASS = ["k", "c1", "c2"]


def numbered_turns(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """``conv``, ``place`` (from 1, by turn, NULL first), ``digest`` and ``n_bytes`` of each turn; no text travels.

    Turns of equal number come in the order of their digests. Rows without a conversation are left out.
    """
    said_by, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    turns = conversations.select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(said_by).cast("string"), F.lit(":"), said_by, said))).alias("digest"),
        F.octet_length(said).cast("long").alias("n_bytes"),
    )
    numbered = number_rows(turns.where("conv IS NOT NULL"), ["turn", "digest"], ["conv"], "place")
    return numbered.select("conv", (F.col("place") + 1).alias("place"), "digest", "n_bytes")


def rebuilt_turns(turns: DataFrame, families: int = 5, longest: int = 8) -> DataFrame:
    """Turns of the conversations rebuilt on the head of the first one of their family.

    Conversation c takes the first h turns of c - c % ``families`` (h: CRC-32 of its decimal id modulo ``longest`` + 1), then
    its own turns after its first h. ``total`` is how many it has; one without turns has one row without a digest.
    """
    turn = F.struct("place", "digest", "n_bytes")
    convs = stage(
        turns.groupBy("conv").agg(F.max("place").alias("n"), F.sort_array(F.collect_list(F.when(F.col("place") <= longest, turn))).alias("head"))
    )
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (longest + 1)).cast("int")
    own = convs.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % families).alias("base"))
    heads = own.join(convs.select(F.col("conv").alias("base"), "head"), "base", "left")
    head = F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.col("h")))
    heads = heads.select("conv", "h", "n", head.alias("head")).withColumn("b", F.greatest(F.size("head"), F.lit(0)))
    heads = heads.withColumn("total", F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    taken = heads.select("conv", "total", F.explode_outer("head").alias("t"))
    taken = taken.select("conv", "total", F.coalesce("t.place", F.lit(1)).alias("place"), "t.digest", "t.n_bytes")
    rest = turns.join(heads.select(F.col("conv").alias("c"), "h", "b", "total"), F.col("conv") == F.col("c")).where("place > h")
    return taken.unionByName(rest.select("conv", "total", (F.col("place") - F.col("h") + F.col("b")).alias("place"), "digest", "n_bytes"))


def _segments(turns: DataFrame) -> DataFrame:
    """A row per conversation and segment: its key, the sizes of its turns, its class, and whether more turns follow."""
    k = F.floor((F.col("place") - 1) / SEGMENT).cast("long")
    turn = F.struct("place", "digest", "n_bytes")
    rows = turns.groupBy("conv", k.alias("k")).agg(
        F.sort_array(F.collect_list(F.when(F.col("digest").isNotNull(), turn))).alias("t"), F.max("total").alias("total")
    )
    rows = rows.select(
        "conv",
        "k",
        F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), "")).alias("key"),
        F.transform("t", lambda x: x["n_bytes"]).alias("sizes"),
        (F.col("total") > (F.col("k") + 1) * SEGMENT).alias("continues"),
        (F.col("total") > SEGMENT).alias("is_long"),
    )
    rows = stage(rows)
    before = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    tags = rows.where("is_long").select("conv", "k", *[tag.alias(f"h{i}") for i, tag in enumerate(_tags(), 1)])
    chains = tags.select("conv", "k", *[F.coalesce(F.bit_xor(f"h{i}").over(before), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    filed = rows.where("is_long").join(chains, ["conv", "k"])
    return filed.unionByName(rows.where("NOT is_long").select("*", *[F.lit(0).cast("long").alias(c) for c in ("c1", "c2")]))


def _tags() -> list[Column]:
    """Two numbers of a segment and its place; a class is their exclusive sums over all segments before."""
    return [F.xxhash64(F.lit(i), "k", "key") for i in (1, 2)]


def shared_turns(one: bytes, other: bytes) -> int:
    """How many leading digests two keys have in common."""
    low, high = 0, min(len(one), len(other)) // DIGEST
    if one[: high * DIGEST] == other[: high * DIGEST]:
        return high
    while high - low > 1:  # the first ``low`` agree, the first ``high`` do not
        middle = (low + high) // 2
        if one[low * DIGEST : middle * DIGEST] == other[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle
    return low


def _with_neighbours(batches):
    """Number the rows of a sorted partition; add the turns shared with the row before (``lcp``) and after (``nlcp``)."""
    part, idx, turns = TaskContext.get().partitionId(), 0, 0
    last, held = None, None

    def finished(batch: pa.RecordBatch, first: int, blocks: np.ndarray, lcp: list, after: int | None):
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns |= {
            "part": pa.array([part] * batch.num_rows, pa.int32()),
            "idx": pa.array(range(first, first + batch.num_rows), pa.int64()),
            "block": pa.array(blocks, pa.int64()),
            "lcp": pa.array(lcp, pa.int32()),
            "nlcp": pa.array([*lcp[1:], after], pa.int32()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = list(zip(*[batch.column(c).to_pylist() for c in (*_CLASS, "key")], strict=True))
        lcp = []
        for row in rows:
            if last is None:
                lcp.append(None)
            else:
                lcp.append(shared_turns(last[3], row[3]) if last[:3] == row[:3] else 0)
            last = row
        if held is not None:
            yield finished(*held, lcp[0])
        work = turns + np.cumsum([len(row[3]) // DIGEST + 4 for row in rows])
        held = batch, idx, work // BLOCK_TURNS, lcp
        idx, turns = idx + batch.num_rows, int(work[-1])
    if held is not None:
        yield finished(*held, None)


def _sorted_segments(rows: DataFrame) -> DataFrame:
    """The segments in order, with their places (``part``, ``idx``) and what they share with both neighbours."""
    order = [*_CLASS, "key", "continues", "conv"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = stage(ordered.mapInArrow(_with_neighbours, f"{kinds}, part int, idx long, block long, lcp int, nlcp int"))
    # partitions have one first and one last row each: compare them across the borders
    first = placed.where("idx = 0").select("part", *[F.col(c).alias(f"f_{c}") for c in (*_CLASS, "key")])
    last = placed.where("nlcp IS NULL").select("part", *[F.col(c).alias(f"l_{c}") for c in (*_CLASS, "key")])
    in_order = Window.orderBy("part")
    edges = first.join(last, "part").select("*", *[F.lag(f"l_{c}").over(in_order).alias(f"p_{c}") for c in (*_CLASS, "key")])
    same = F.lit(True)
    for c in _CLASS:
        same = same & (F.col(f"f_{c}") == F.col(f"p_{c}"))
    most = F.least(F.octet_length("f_key"), F.octet_length("p_key")) / DIGEST
    equal = lambda i: F.substr("f_key", F.lit(1), i * DIGEST) == F.substr("p_key", F.lit(1), i * DIGEST)
    shared = F.aggregate(F.sequence(F.lit(0), most.cast("int")), F.lit(0), lambda found, i: F.when(equal(i), F.greatest(found, i)).otherwise(found))
    edges = edges.select("part", F.when(same, shared).otherwise(0).alias("first_lcp"))
    edges = stage(edges.select("part", "first_lcp", F.coalesce(F.lead("first_lcp").over(in_order), F.lit(0)).alias("after")))
    joined = placed.join(edges, "part")
    return joined.withColumns({"lcp": F.coalesce("lcp", "first_lcp"), "nlcp": F.coalesce("nlcp", "after")}).drop("first_lcp", "after")


def _with_later_segments(rows: DataFrame) -> DataFrame:
    """Add what each segment shares in bytes and whether it ends in a leaf, and the sums of both over later segments."""
    shared = F.aggregate(F.slice("sizes", F.lit(1), F.greatest("lcp", F.lit(1))), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumns(
        {
            "shared": F.when(F.col("lcp") > 0, shared).otherwise(0),
            "leaf": (~F.col("continues") & (F.col("nlcp") < F.size("sizes"))).cast("long"),
        }
    )
    later = Window.partitionBy("conv").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.where("is_long").select(
        F.col("conv").alias("conv_"), F.col("k").alias("k_"), F.sum("shared").over(later).alias("later_shared"), F.sum("leaf").over(later).alias("later_leaves")
    )
    long = rows.where("is_long").join(sums, (F.col("conv") == F.col("conv_")) & (F.col("k") == F.col("k_"))).drop("conv_", "k_")
    zero = F.lit(0).cast("long")
    rows = rows.where("NOT is_long").withColumns({"later_shared": zero, "later_leaves": zero}).unionByName(long)
    after = [F.col(f"c{i}").bitwiseXOR(tag).alias(f"n{i}") for i, tag in enumerate(_tags(), 1)]
    return rows.select("*", *after).withColumns({"later_shared": F.coalesce("later_shared", zero), "later_leaves": F.coalesce("later_leaves", zero)})


class RangeMinima:
    """Minima of any range of ``values`` from two entries of a table whose row l has those of 2 ** l successive values."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half = 1 << (len(self.rows) - 1)
            top = self.rows[-1]
            self.rows.append(np.minimum(top[:-half], top[half:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), self.rows[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][first[at]], self.rows[k][last[at] + 1 - (1 << int(k))])
        return out

    def extents(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row around ``at`` whose common prefix with it has ``depth`` turns; values are the shared turns."""
        n, left, right = len(self.rows[0]), at.copy(), at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            step, row = 1 << k, self.rows[k]
            goes = right + step < n
            goes[goes] = row[right[goes] + 1] >= depth[goes]
            right[goes] += step
            goes = left - step >= 0
            goes[goes] = row[left[goes] - step + 1] >= depth[goes]
            left[goes] -= step
        return left, right


_FOUND = (
    "kind int, ref binary, conv_id long, depth long, parent_conv_id long, parent_ref binary, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, next_ref binary, part int, idx long, ends string"
)
_COMPLETE, _PARTIAL, _ENDS = 0, 1, 2
_ROOT = b"root"
_NOTHING = hashlib.sha256(b"").hexdigest()


def _class_ref(k: int, c1: int, c2: int) -> bytes:
    return struct.pack(">Bqqq", 1, k, c1, c2) if k else _ROOT


def _prefixes_of_block(block: pd.DataFrame) -> pd.DataFrame:
    """The prefixes that begin in a block of successive rows, and those that reach into it."""
    block = block.sort_values("idx", ignore_index=True)
    n = len(block)
    lcp, nlcp, conv, k, c1, c2 = (block[c].to_numpy(np.int64) for c in ("lcp", "nlcp", "conv", "k", "c1", "c2"))
    ended = ~block["continues"].to_numpy(bool)
    keys = block["key"].tolist()
    length = np.array([len(s) for s in block["sizes"]], np.int64)
    begin = np.concatenate([[0], np.cumsum(length)])
    flat = np.concatenate([[0], np.cumsum(np.concatenate([np.asarray(s, np.int64) for s in block["sizes"]]) if begin[-1] else np.zeros(0, np.int64))])
    upto = lambda row, depth: flat[begin[row] + depth] - flat[begin[row]]  # noqa: E731  bytes of the first turns of a row
    total = lambda values: np.concatenate([[0], np.cumsum(values)])
    shared, later = total(block["shared"].to_numpy(np.int64)), total(block["later_shared"].to_numpy(np.int64))
    leaves = total((block["leaf"] + block["later_leaves"]).to_numpy(np.int64))
    on = np.zeros(n, bool)  # the same conversation as the row before, both at their end
    on[1:] = (lcp[1:] == length[1:]) & (lcp[1:] == length[:-1]) & ended[1:] & ended[:-1] & (length[1:] > 0)
    starts = np.flatnonzero(~on)
    run_end = np.append(starts[1:], n)[np.cumsum(~on) - 1]
    branching = np.sort((lcp * n + np.arange(n))[length > lcp])
    minima, smallest = RangeMinima(lcp), RangeMinima(conv)

    fresh = length - lcp
    fresh[0] = length[0]
    at = np.repeat(np.arange(n), fresh)
    depth = np.arange(len(at)) - np.repeat(np.cumsum(fresh) - fresh, fresh) + 1 + np.repeat(np.where(np.arange(n) > 0, lcp, 0), fresh)

    def interval(at, depth):
        left, right = minima.extents(at, depth)
        return left, right, (left == 0) & (lcp[0] >= depth), (right == n - 1) & (nlcp[-1] >= depth)

    left, right, from_before, goes_on = interval(at, depth)
    partial = from_before | goes_on
    below = np.maximum(depth - 1, 1)
    p_left, p_right, p_before, p_on = interval(at, below)
    parent = smallest.of(p_left, p_right) if len(at) else at
    first_bytes = upto(at, depth - 1)
    saved = shared[right + 1] - shared[left + 1] - (right - left) * first_bytes + later[right + 1] - later[left]
    saved += np.where(from_before, shared[left + 1] - shared[left] - first_bytes, 0)
    children = np.searchsorted(branching, depth * n + right, side="right") - np.searchsorted(branching, depth * n + left, side="right")
    children += (length[left] > depth) & (lcp[left] <= depth)
    n_ended = np.where((length[left] == depth) & ended[left], np.minimum(run_end[left], right + 1) - left, 0)

    def ref(row: int, d: int) -> bytes:
        return struct.pack(">Bqqqq", 2, k[row], c1[row], c2[row], d) + hashlib.md5(keys[row][: d * DIGEST]).digest()

    refs: dict[tuple, bytes] = {}

    def edge_ref(before: bool, d: int) -> bytes:
        if (before, d) not in refs:
            refs[before, d] = ref(0 if before else n - 1, d)
        return refs[before, d]

    m = len(at)
    own, parent_ref, next_ref, sha = [None] * m, [None] * m, [None] * m, [None] * m
    known = (depth > 1) & ~(p_before | p_on)
    for i in np.flatnonzero(~known):
        row = at[i]
        parent_ref[i] = edge_ref(bool(p_before[i]), int(below[i])) if depth[i] > 1 else _class_ref(int(k[row]), int(c1[row]), int(c2[row]))
    for i in np.flatnonzero((depth == SEGMENT) & ~ended[right]):
        row = block.iloc[int(right[i])]
        next_ref[i] = _class_ref(int(row["k"]) + 1, int(row["n1"]), int(row["n2"]))
    pieces = []

    def add_pieces(name: bytes, first: int, count: int):
        for a in range(first, first + count, PIECE):
            ids = ",".join(map(str, conv[a : min(a + PIECE, first + count)]))
            pieces.append((name, int(block["part"].iloc[0]), int(block["idx"].iloc[a]), ids))

    for i in range(m):
        if partial[i]:
            own[i] = edge_ref(bool(from_before[i]), int(depth[i]))
            if n_ended[i]:
                add_pieces(own[i], int(left[i]), int(n_ended[i]))
        elif n_ended[i]:
            sha[i] = hashlib.sha256(",".join(map(str, conv[left[i] : left[i] + n_ended[i]])).encode()).hexdigest()
        else:
            sha[i] = _NOTHING
    empty = int(np.count_nonzero((length == 0) & (k == 0)))  # conversations without turns come first of all
    if empty:
        add_pieces(_ROOT, 0, empty)
    nodes = pd.DataFrame(
        {
            "kind": np.where(partial, _PARTIAL, _COMPLETE).astype(np.int32),
            "ref": own,
            "conv_id": smallest.of(left, right) if m else at,
            "depth": k[at] * SEGMENT + depth,
            "parent_conv_id": pd.array(np.where(known, parent, 0), "Int64"),
            "parent_ref": parent_ref,
            "n_convs": right - left + 1,
            "n_children": children,
            "n_leaves": leaves[right + 1] - leaves[left],
            "saved_tokens": saved,
            "ends_sha256": sha,
            "next_ref": next_ref,
        }
    )
    nodes.loc[~known, "parent_conv_id"] = pd.NA
    ends = pd.DataFrame(pieces, columns=["ref", "part", "idx", "ends"]).assign(kind=_ENDS)
    both = pd.concat([nodes, ends], ignore_index=True)
    columns = [c.split()[0] for c in _FOUND.split(", ")]
    return both.reindex(columns=columns).astype({"kind": "int32"} | {c: "Int64" for c in columns if c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "idx", "part")})


def _hashed(batches):
    """SHA-256 of the pieces of each name, fed in order; a piece at a time is held."""
    name, state, names, found = None, None, [], []
    for batch in batches:
        for ref, ends in zip(batch.column("ref").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if ref != name:
                if name is not None:
                    names.append(name)
                    found.append(state.hexdigest())
                name, state = ref, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.string())], names=["ended_ref", "sha"])
            names, found = [], []
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["ended_ref", "sha"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of sequences of turns.

    ``turns`` has ``conv``, ``place`` (from 1 without gaps), ``digest`` (16 bytes; NULL: the conversation has no turn),
    ``n_bytes`` and ``total``, as ``rebuilt_turns`` gives them. A node is a distinct sequence of leading turns, the root
    has none: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (NULL for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` (of the ids that end here). No conversations give no nodes.
    """
    rows = stage(_with_later_segments(_sorted_segments(stage(_segments(turns)))))
    found = stage(rows.groupBy("part", "block").applyInPandas(_prefixes_of_block, _FOUND))

    length = F.size("sizes")
    begins = ((F.col("lcp") == 0) & (length > 0)).cast("long")
    root = rows.where("k = 0").agg(
        F.min("conv").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(begins).alias("n_children"),
        F.greatest(F.sum(F.col("leaf") + F.col("later_leaves")), F.lit(1)).alias("n_leaves"),
        F.sum(F.col("shared") + F.col("later_shared")).alias("saved_tokens"),
    )
    root = stage(root.where("n_convs > 0"))
    pieces = found.where(F.col("kind") == _ENDS).select("ref", "part", "idx", "ends")
    ends = pieces.repartition("ref").sortWithinPartitions("ref", "part", "idx").mapInArrow(_hashed, "ended_ref binary, sha string")
    ends = stage(ends)

    merged = found.where(F.col("kind") == _PARTIAL).groupBy("ref").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max("parent_ref").alias("parent_ref"),
        F.max("next_ref").alias("next_ref"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    merged = stage(merged)
    merged_nodes = merged.join(ends, F.col("ref") == F.col("ended_ref"), "left").withColumns(
        {"parent_conv_id": F.lit(None).cast("long"), "ends_sha256": F.coalesce("sha", F.lit(_NOTHING))}
    )
    figures = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    kept = [*figures, "parent_ref", "next_ref"]
    nodes = found.where(F.col("kind") == _COMPLETE).select(*kept).unionByName(merged_nodes.select(*kept))

    # a node after whose turns a segment ends has the first turns of the next segments as children
    ref = F.expr(f"CASE WHEN k > 0 THEN concat(unhex('01'), unhex(lpad(hex(k), 16, '0')), unhex(lpad(hex(c1), 16, '0')), unhex(lpad(hex(c2), 16, '0'))) END")
    onward = stage(rows.where("k > 0").groupBy(ref.alias("class_ref")).agg(F.sum(begins).alias("more")))
    inner = nodes.where("next_ref IS NULL")
    border = nodes.where("next_ref IS NOT NULL").join(onward, F.col("next_ref") == F.col("class_ref"))
    border = border.withColumn("n_children", F.col("n_children") + F.col("more")).select(*kept)
    nodes = inner.unionByName(border)

    # parents that no block knew whole
    parents = stage(merged.select("ref", F.col("conv_id").alias("p")).unionByName(border.select(F.col("next_ref").alias("ref"), F.col("conv_id").alias("p"))))
    top = root.first()
    settled = nodes.where("parent_ref IS NULL").select(*figures)
    under_root = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(top and top["conv_id"]).cast("long")).select(*figures)
    others = nodes.where("parent_ref IS NOT NULL AND depth > 1").join(parents, F.col("parent_ref") == F.col("ref"))
    others = others.withColumn("parent_conv_id", F.col("p")).select(*figures)
    root_ends = ends.where(F.col("ended_ref") == F.lit(_ROOT))
    root_row = root.join(root_ends, F.lit(True), "left").select(
        "conv_id",
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("sha", F.lit(_NOTHING)).alias("ends_sha256"),
    )
    return root_row.unionByName(under_root).unionByName(settled).unionByName(others)


def conversation_trie(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations of a table.

    A NULL role or text is empty, a NULL turn comes first; turns of equal number are ordered by the MD5 digest of role and
    text, repeated rows are turns of their own. Rows without a conversation id are left out. Other columns are not looked at.
    """
    return prefix_trie(rebuilt_turns(numbered_turns(conversations, conv_id, turn, role, text)))
