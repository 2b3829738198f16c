"""Near duplicates among vectors by NN-descent.

Every vector keeps a list of its nearest known neighbours. The lists start from blocks of vectors that lie next to each other
in a few random orders, and are refined in rounds: the vectors that meet at a common neighbour are compared with each other,
and what is nearer than the last entry of a list moves in. A list that is full of links gets more room. A bounded sample of
vectors is compared with all, which tells the recall of the lists. The entries at the threshold or above are links; their
components are found, and within a component every vector's links are counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regionloom.llm.components import components
from regionloom.operators.positions import number_rows
from regionloom.session import stage

THRESHOLD = 0.9
#: Entries of a list at the start, and at most; what has more links is counted in its component.
FIRST_ROOM, MOST_ROOM = 12, 48
#: Random orders at the start, and how many hyperplanes make one.
ORDERS, PLANES = 6, 30
#: Vectors compared with each other at once.
BLOCK_ROWS = 512
MOST_ROUNDS = 8
#: A round that changes a smaller share of the entries is the last.
SETTLED = 0.002
#: Vectors that are compared with all others to learn the recall, and the recall below which the search goes on.
AUDIT_ROWS, RECALL = 2048, 0.98
#: Rounding leaves angles this far in doubt.
_SLACK = 1e-6


def _valid_vectors(embedding: str, wide: bool):
    """The bytes of each vector (``vec``), NULL for those that link with nothing."""
    kind = np.float64 if wide else np.float32

    def convert(batches):
        for batch in batches:
            column = batch.column(embedding)
            vectors = []
            for vector in column.to_pylist() if column.null_count or column.flatten().null_count else _rows(column):
                if vector is not None and not isinstance(vector, np.ndarray):
                    vector = None if any(x is None for x in vector) else np.array(vector, kind)
                good = vector is not None and len(vector) > 0 and np.isfinite(vector).all() and vector.any()
                vectors.append(vector.astype(kind).tobytes() if good else None)
            kept = [batch.column(name) for name in batch.schema.names if name != embedding]
            names = [name for name in batch.schema.names if name != embedding]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(vectors, pa.binary())], names=[*names, "vec"])

    return convert


def _rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
    return (values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def _units(vectors: pa.Array, wide: bool) -> np.ndarray:
    """Unit vectors in double precision from the bytes of vectors of equal length."""
    data = np.frombuffer(b"".join(vectors.to_pylist()), np.float64 if wide else np.float32)
    x = data.reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _runs(batches, *names: str, most: int | None = None) -> Iterator[pa.Table]:
    """Stretches of a sorted stream that agree in the named columns, cut after ``most`` rows where given."""
    held: list[pa.RecordBatch] = []
    key = None

    def rows() -> int:
        return sum(b.num_rows for b in held)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = list(zip(*[batch.column(n).to_pylist() for n in names], strict=True))
        start = 0
        while start < len(keys):
            if held and (keys[start] != key or (most and rows() >= most)):
                yield pa.Table.from_batches(held)
                held = []
            key, end = keys[start], start
            limit = len(keys) if not most else min(len(keys), start + most - rows())
            while end < limit and keys[end] == key:
                end += 1
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield pa.Table.from_batches(held)


_ENTRY = "a long, b long, cos double"


def _entries(a, b, cos) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cos, pa.float64())], names=["a", "b", "cos"])


def _in_orders(wide: bool, width: int):
    """Each vector once for every random order, with the sides of the order's planes on which it lies."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("vec").to_pylist()]) // width
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([7, int(dim)]).standard_normal((int(dim), ORDERS * PLANES))
                sides = (_units(part.column("vec"), wide) @ planes[dim] > 0).reshape(part.num_rows, ORDERS, PLANES)
                codes = sides @ (1 << np.arange(PLANES - 1, -1, -1, dtype=np.int64))
                for t in range(ORDERS):
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(dim)] * n, pa.int32()), pa.array([t] * n, pa.int32()), pa.array(codes[:, t]), part.column("rid"), part.column("vec")],
                        names=["dim", "order", "code", "rid", "vec"],
                    )

    return run


def _nearest_in_blocks(wide: bool):
    """The nearest of each vector among the block of successive vectors it stands in."""

    def run(batches):
        for block in _runs(batches, "dim", "order", most=BLOCK_ROWS):
            rid = block.column("rid").to_numpy()
            n = len(rid)
            if n < 2:
                continue
            x = _units(block.column("vec").combine_chunks(), wide)
            cos = x @ x.T
            np.fill_diagonal(cos, -2)
            k = min(FIRST_ROOM, n - 1)
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            yield _entries(np.repeat(rid, k), rid[near].ravel(), np.take_along_axis(cos, near, 1).ravel())

    return run


def _lists(entries: DataFrame) -> DataFrame:
    """The nearest ``room`` entries of each vector (``a``, ``room``, ``near``) from ``a``, ``b``, ``cos``, ``fresh``, ``room``."""
    once = entries.repartition("a").groupBy("a", "b").agg(F.max("cos").alias("cos"), F.min("fresh").alias("fresh"), F.max("room").alias("room"))
    lists = once.groupBy("a").agg(F.coalesce(F.max("room"), F.lit(FIRST_ROOM)).alias("room"), F.collect_list(F.struct("cos", "b", "fresh")).alias("near"))
    return lists.select("a", "room", F.slice(F.sort_array("near", asc=False), F.lit(1), F.col("room")).alias("near"))


def _meetings(wide: bool):
    """Compare the vectors that meet at a common neighbour ``u``; gives entries that are nearer than what a list ends with."""

    def compared(table: pa.Table):
        u, m, kth, fresh = (table.column(c).to_numpy() for c in ("u", "m", "kth", "fresh"))
        x = _units(table.column("vec").combine_chunks(), wide)
        starts = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        sizes = np.diff(np.append(starts, len(u)))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 1]
        done = 0
        while done < len(order):
            most = sizes[order[min(len(order), done + 256) - 1]]
            groups = order[done : done + max(1, min(256, (1 << 21) // (most * max(most, x.shape[1]))))]
            done += len(groups)
            width = sizes[groups].max()
            at = starts[groups][:, None] + np.arange(width)
            there = np.arange(width) < sizes[groups][:, None]
            at = np.where(there, at, 0)
            cos = np.matmul(x[at], x[at].transpose(0, 2, 1))
            news = fresh[at] & there
            may = (cos > kth[at][:, :, None]) & there[:, :, None] & there[:, None, :] & (news[:, :, None] | news[:, None, :])
            g, i, j = np.nonzero(may)
            a, b = m[at[g, i]], m[at[g, j]]
            off = a != b
            pairs, which = np.unique(np.column_stack([a[off], b[off]]), axis=0, return_index=True)
            if len(pairs):
                yield _entries(pairs[:, 0], pairs[:, 1], cos[g, i, j][off][which])

    def run(batches):
        held, rows, dim = [], 0, None
        for group in _runs(batches, "u"):
            of = len(group.column("vec")[0].as_py())
            if held and (of != dim or rows + group.num_rows > 1 << 14):
                yield from compared(pa.concat_tables(held))
                held, rows = [], 0
            held.append(group)
            rows, dim = rows + group.num_rows, of
        if held:
            yield from compared(pa.concat_tables(held))

    return run


def _refined(lists: DataFrame, reps: DataFrame, wide: bool) -> DataFrame:
    """One round: neighbours of neighbours through the vector between them; lists full of links get twice the room."""
    entry = lists.select("a", F.explode("near").alias("e")).select("a", "e.b", "e.cos", "e.fresh")
    # how many lists a vector stands in has no bound; about twice the first room of them meet at it in a round
    listed = entry.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    chosen = F.pmod(F.xxhash64("a", "b", F.lit(11)), F.lit(1 << 20)) < F.lit(2 * FIRST_ROOM << 20) / F.col("n")
    back = entry.join(listed, "b").where(chosen).select(F.col("b").alias("u"), F.col("a").alias("m"), "fresh")
    members = entry.select(F.col("a").alias("u"), F.col("b").alias("m"), "fresh").unionByName(back)
    members = members.groupBy("u", "m").agg(F.max("fresh").alias("fresh"))
    full = F.size("near") >= F.col("room")
    last = F.when(full, F.element_at("near", -1)["cos"]).otherwise(F.lit(-2.0))
    state = lists.select("a", last.alias("kth")).join(reps.select(F.col("rid").alias("a"), "vec"), "a")
    meeting = members.join(state, F.col("m") == F.col("a")).select("u", "m", "fresh", "kth", "vec")
    meeting = meeting.repartition("u").sortWithinPartitions("u")
    candidates = meeting.mapInArrow(_meetings(wide), _ENTRY)
    wider = F.when(full & (last >= THRESHOLD), F.least(2 * F.col("room"), F.lit(MOST_ROOM))).otherwise(F.col("room"))
    old = lists.select("a", wider.cast("int").alias("room"), F.explode("near").alias("e")).select("a", "e.b", "e.cos", F.lit(False).alias("fresh"), "room")
    new = candidates.select("a", "b", "cos", F.lit(True).alias("fresh"), F.lit(None).cast("int").alias("room"))
    return _lists(old.unionByName(new))


def _audit_truth(reps: DataFrame, wide: bool) -> DataFrame:
    """How many links each vector of a bounded sample has among all vectors (``a``, ``links``)."""
    sample = reps.orderBy(F.xxhash64("rid", F.lit(5)), "rid").limit(AUDIT_ROWS).select("rid", "vec").collect()
    by_dim: dict[int, list] = {}
    for row in sample:
        by_dim.setdefault(len(row["vec"]), []).append(row)
    known = {dim: (np.array([r["rid"] for r in rows]), _units(pa.array([bytes(r["vec"]) for r in rows]), wide)) for dim, rows in by_dim.items()}

    def run(batches):
        found = {dim: np.zeros(len(ids), np.int64) for dim, (ids, _) in known.items()}
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("vec").to_pylist()])
            for dim, (_, x) in known.items():
                at = np.flatnonzero(sizes == dim)
                for some in np.array_split(at, len(at) // 2048 + 1):
                    if len(some):
                        found[dim] += (x @ _units(batch.column("vec").take(pa.array(some)), wide).T >= THRESHOLD).sum(axis=1)
        for dim, (ids, _) in known.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found[dim])], names=["a", "links"])

    counted = reps.select("vec").mapInArrow(run, "a long, links long")
    # every vector of the sample finds itself once
    return stage(counted.groupBy("a").agg((F.sum("links") - 1).alias("links")))


def _recall(lists: DataFrame, truth: DataFrame) -> float:
    """Share of the sample's links that its lists hold; a list can hold no more than its room."""
    held = lists.join(truth, "a").select("links", "room", F.size(F.filter("near", lambda e: e["cos"] >= THRESHOLD)).alias("held"))
    got, there = held.agg(F.sum(F.least("held", "links")), F.sum(F.least("links", F.col("room").cast("long")))).first()
    return got / there if there else 1.0


def _spread_out(wide: bool):
    """Sums of the unit vectors of each component, from the rows of a task."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for root, vec in zip(batch.column("root").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                x = _units(pa.array([vec]), wide)[0]
                sums[root] = sums[root] + x if root in sums else x
            if len(sums) > 4096:
                yield from made(sums)
                sums = {}
        yield from made(sums)

    def made(sums):
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tobytes() for s in sums.values()])], names=["root", "total"])

    return run


def _centres(batches):
    for run in _runs(batches, "root"):
        total = sum(np.frombuffer(t.as_py()) for t in run.column("total"))
        norm = np.linalg.norm(total)
        yield pa.RecordBatch.from_arrays([run.column("root").combine_chunks()[:1], pa.array([(total / norm if norm else total).tobytes()])], names=["centre_of", "centre"])


def _angles(wide: bool):
    def run(batches):
        for batch in batches:
            angles = []
            for vec, centre in zip(batch.column("vec").to_pylist(), batch.column("centre").to_pylist(), strict=True):
                angles.append(math.acos(min(1.0, max(-1.0, float(_units(pa.array([vec]), wide)[0] @ np.frombuffer(centre))))))
            kept = [batch.column(c) for c in ("root", "v", "copies", "vec")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(angles)], names=["root", "v", "copies", "vec", "angle"])

    return run


def _links_in_runs(wide: bool, *names: str):
    """For each row that is ``asked``: copies of the rows of its run that it links with, itself included."""

    def run(batches):
        for group in _runs(batches, *names):
            x = _units(group.column("vec").combine_chunks(), wide)
            copies, asked, v = (group.column(c).to_numpy() for c in ("copies", "asked", "v"))
            for some in np.array_split(np.flatnonzero(asked), np.count_nonzero(asked) // 2048 + 1):
                if len(some):
                    others = copies * group.column("answers").to_numpy().astype(np.int64)
                    linked = (x[some] @ x.T >= THRESHOLD) @ others
                    yield pa.RecordBatch.from_arrays([pa.array(v[some]), pa.array(linked.astype(np.int64))], names=["v", "linked"])

    return run


_LINKED = "v long, linked long"


def _exact_links(members: DataFrame, wide: bool) -> DataFrame:
    """``v`` and ``linked`` (copies of the members of its component within the threshold, its own included).

    Components of up to a block are compared whole. A larger one is cut into blocks by the angle to its mean: two blocks
    whose largest angles add up to less than the threshold's angle are linked throughout, two whose angles lie further
    apart than it not at all, and only the other pairs of blocks are compared.
    """
    sizes = stage(members.groupBy("root").agg(F.count(F.lit(1)).alias("size")))
    sized = members.join(sizes, "root")
    small = sized.where(F.col("size") <= BLOCK_ROWS).select("root", "v", "copies", "vec", F.lit(True).alias("asked"), F.lit(True).alias("answers"))
    counted = small.repartition("root").sortWithinPartitions("root").mapInArrow(_links_in_runs(wide, "root"), _LINKED)
    large = sized.where(F.col("size") > BLOCK_ROWS)
    if large.isEmpty():
        return counted
    large = stage(large.select("root", "v", "copies", "vec"))
    sums = large.mapInArrow(_spread_out(wide), "root long, total binary")
    centres = stage(sums.repartition("root").sortWithinPartitions("root").mapInArrow(_centres, "centre_of long, centre binary"))
    apart = large.join(centres, F.col("root") == F.col("centre_of")).select("root", "v", "copies", "vec", "centre")
    apart = apart.mapInArrow(_angles(wide), "root long, v long, copies long, vec binary, angle double")
    placed = number_rows(apart, ["angle", "v"], ["root"], "place").withColumn("block", F.floor(F.col("place") / BLOCK_ROWS)).drop("place")
    placed = stage(placed)
    blocks = stage(
        placed.groupBy("root", "block").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.sum("copies").alias("copies"))
    )
    limit = math.acos(THRESHOLD)
    whole = blocks.groupBy(F.col("root").alias("root_")).agg(F.max("high").alias("highest"), F.sum("copies").alias("all_copies"))
    known = blocks.join(whole, F.col("root") == F.col("root_")).drop("root_")
    sure = F.col("high") + F.col("highest") <= limit - _SLACK
    all_linked = known.where(sure).select("root", "block", F.col("all_copies").alias("sure_copies"))
    other = blocks.select(*[F.col(c).alias(f"o_{c}") for c in blocks.columns])
    pairs = known.where(~sure).join(other, F.col("root") == F.col("o_root"))
    linked = F.col("high") + F.col("o_high") <= limit - _SLACK
    never = F.greatest(F.col("low") - F.col("o_high"), F.col("o_low") - F.col("high")) > limit + _SLACK
    pairs = stage(pairs.select("root", "block", "o_block", F.when(linked, "all").when(never, "none").otherwise("some").alias("how"), "o_copies"))
    some_linked = pairs.groupBy("root", "block").agg(F.sum(F.when(F.col("how") == "all", F.col("o_copies")).otherwise(0)).alias("sure_copies"))
    base = stage(all_linked.unionByName(some_linked)).select(F.col("root").alias("r"), F.col("block").alias("b"), "sure_copies")
    by_bound = placed.join(base, (F.col("root") == F.col("r")) & (F.col("block") == F.col("b"))).select("v", F.col("sure_copies").alias("linked"))
    doubt = pairs.where("how = 'some'").select(F.col("root").alias("r"), F.col("block").alias("x"), F.col("o_block").alias("y"))
    asking = placed.join(doubt, (F.col("root") == F.col("r")) & (F.col("block") == F.col("x")))
    asking = asking.withColumns({"asked": F.lit(True), "answers": F.col("x") == F.col("y")})
    answering = placed.join(doubt.where("x <> y"), (F.col("root") == F.col("r")) & (F.col("block") == F.col("y")))
    answering = answering.withColumns({"asked": F.lit(False), "answers": F.lit(True)})
    columns = ["root", "x", "y", "v", "copies", "vec", "asked", "answers"]
    both = asking.select(*columns).unionByName(answering.select(*columns))
    compared = both.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(_links_in_runs(wide, "root", "x", "y"), _LINKED)
    return counted.unionByName(by_bound.unionByName(compared).groupBy("v").agg(F.sum("linked").alias("linked")))


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for each row.

    Two rows are linked if the cosine of their vectors, in double precision, is 0.9 or more and the search finds them
    connected. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id that links lead to
    (the own one included), ``kept`` tells whether that is the row's own. Vectors that are NULL, empty, zero or hold NULL or
    non-finite components link with nothing, vectors of different lengths not with each other. Rows of equal vectors, also
    repeated rows, are linked with each other; a row without an id takes part, but gives its component no id, and is kept
    only where no other row has one. Other columns are not looked at. No rows give none.
    """
    wide = vectors.schema[embedding].dataType.elementType.typeName() != "float"
    plain = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(f"array<{'double' if wide else 'float'}>").alias("embedding"))
    rows = stage(plain.mapInArrow(_valid_vectors("embedding", wide), "id long, vec binary"))
    reps = rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    reps = stage(reps.withColumn("rid", F.monotonically_increasing_id()))
    n = reps.count()
    width = 8 if wide else 4
    ordered = reps.select("rid", "vec").mapInArrow(_in_orders(wide, width), "dim int, order int, code long, rid long, vec binary")
    by_code = ["dim", "order", "code", "rid"]
    ordered = ordered.repartitionByRange(*by_code).sortWithinPartitions(*by_code)
    start = ordered.mapInArrow(_nearest_in_blocks(wide), _ENTRY)
    lists = stage(_lists(start.select("*", F.lit(True).alias("fresh"), F.lit(None).cast("int").alias("room"))))
    truth = _audit_truth(reps, wide)
    for _ in range(MOST_ROUNDS):
        lists = stage(_refined(lists, reps, wide))
        changed = lists.agg(F.sum(F.size(F.filter("near", lambda e: e["fresh"])))).first()[0] or 0
        if changed <= SETTLED * FIRST_ROOM * n or (_recall(lists, truth) >= RECALL and changed <= 50 * SETTLED * FIRST_ROOM * n):
            break
    links = lists.select("a", F.explode("near").alias("e")).where(F.col("e.cos") >= THRESHOLD)
    roots = components(links.select("a", "e.b"))
    members = stage(reps.join(roots, F.col("rid") == F.col("v")).select("root", "v", "copies", "vec", "first"))
    least = members.groupBy(F.col("root").alias("root_")).agg(F.min("first").alias("component"))
    named = members.select("root", "v").join(least, F.col("root") == F.col("root_")).select("v", "component")
    exact = _exact_links(members.select("root", "v", "copies", "vec"), wide)
    known = reps.join(named, F.col("rid") == F.col("v"), "left").drop("v").join(exact, F.col("rid") == F.col("v"), "left")
    known = known.select(
        F.col("vec").alias("of"),
        (F.coalesce("linked", "copies") - 1).alias("links"),
        F.coalesce("component", "first").alias("component"),
    )
    joined = rows.join(stage(known), F.col("vec") == F.col("of"), "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
