"""Encoding texts into the pieces of a public SentencePiece vocabulary, and decoding them.

A text becomes the sequence of pieces with the largest sum of scores (max-plus); of equal sums the one whose last piece is
longest, then the one before it, and so on. Scores are whole numbers, by Zipf's rule from the rank of a piece in the
vocabulary. A space belongs to the piece after it, and one space is put before the text; a byte without a fitting piece is a
byte piece. So every text comes back from its pieces byte by byte.

A giant text is cut into chunks. A chunk's state at its left edge is how many bytes of it the last piece from the left has
taken. Each chunk gives a matrix of the best sums from each state to each state of the next chunk. The matrices are
combined by the max-plus product, which is associative, so a running product over the chunks gives the best sums at all
edges; from these each chunk maps a state at its right edge to the one at its left edge, the maps are composed from the end,
and each chunk is then traced back by itself. Matrices and maps are small; the texts of the chunks stay apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regionloom.llm.text import Rolling, Texts, by_slices
from regionloom.session import stage

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_BYTES = 1 << 16
SPACE = 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.int64(-(1 << 60))


class Pieces:
    """A vocabulary: piece bytes (a leading space instead of the mark), ids and scores. Bounded; it is read on the driver."""

    def __init__(self, model_file: str = MODEL, zipf: int = 100):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.byte_ids = np.zeros(256, np.int32)
        found: dict[bytes, int] = {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw = piece.replace("▁", " ").encode()
                if b" " not in raw[1:]:
                    found.setdefault(raw, i)
        scores = {p: -round(1000 * float(np.log(rank + zipf))) for rank, p in enumerate(found)}
        self.set(found, scores, model.vocab_size())

    @classmethod
    def of(cls, scores: dict[bytes, int]) -> Pieces:
        """A vocabulary of given pieces and scores; ids from 256 on, byte pieces below."""
        own = object.__new__(cls)
        own.byte_ids = np.arange(256, dtype=np.int32)
        own.set({p: 256 + k for k, p in enumerate(scores)}, scores, 256 + len(scores))
        return own

    def set(self, ids: dict[bytes, int], scores: dict[bytes, int], size: int) -> None:
        self.longest = max((len(p) for p in ids), default=1)
        self.byte_score = min(scores.values(), default=0) - 2000
        self.table = {p: (scores[p], i) for p, i in ids.items()}
        self.bytes_of = [b""] * size
        for p, i in ids.items():
            self.bytes_of[i] = p
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.by_length = {}
        for length in sorted({len(p) for p in ids}, reverse=True):
            own = [p for p in ids if len(p) == length]
            hashes = np.array([_hash(p) for p in own], np.uint64)
            order = np.argsort(hashes)
            self.by_length[length] = (
                hashes[order],
                np.array([scores[p] for p in own], np.int64)[order],
                np.array([ids[p] for p in own], np.int32)[order],
            )


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_BASE) + b + 1) & ((1 << 64) - 1)
    return h


def edges(data: bytes, start: int, vocabulary: Pieces, end: int):
    """Pieces at ``start``: (end of piece, score, id), the byte piece among them."""
    for length in range(1, min(vocabulary.longest, end - start) + 1):
        found = vocabulary.table.get(data[start : start + length])
        if found:
            yield start + length, *found
    yield start + 1, vocabulary.byte_score, int(vocabulary.byte_ids[data[start]])


def best_path(data: bytes, given: dict[int, int], vocabulary: Pieces, starts_before: int) -> tuple[dict, dict]:
    """Best sums at the nodes of ``data``, from nodes with given sums, by pieces that start before ``starts_before``.

    Also the last piece to each node: (start, id), the longest of equal sums; None where the given sum is better or equal.
    """
    best: dict[int, int] = dict(given)
    last: dict[int, tuple[int, int] | None] = {p: None for p in given}
    for at in range(starts_before):
        if at in best:
            for end, score, piece in edges(data, at, vocabulary, len(data)):
                if end not in best or best[at] + score > best[end]:
                    best[end], last[end] = best[at] + score, (at, piece)
    return best, last


def encode_units(units: list[bytes], vocabulary: Pieces) -> tuple[list[np.ndarray], np.ndarray]:
    """Piece ids and sum of scores of each of some byte strings, side by side for those of equal length."""
    ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(units)
    sums = np.zeros(len(units), np.int64)
    lengths = np.array([len(u) for u in units], np.int64)
    for length in np.unique(lengths):
        which = np.flatnonzero(lengths == length)
        if length == 0:
            continue
        if length > 200:
            for k in which:
                best, last = best_path(units[k], {0: 0}, vocabulary, int(length))
                ids[k], sums[k] = _traced(last, int(length)), best[int(length)]
            continue
        data = np.frombuffer(b"".join(units[k] for k in which), np.uint8).reshape(-1, length)
        n = len(which)
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _BASE + data[:, j] + np.uint64(1)
        powers = np.cumprod(np.full(length + 1, _BASE, np.uint64))
        best = np.full((length + 1, n), _LOW, np.int64)
        best[0] = 0
        back = np.zeros((length + 1, n), np.int32)
        piece = np.zeros((length + 1, n), np.int32)
        for j in range(1, length + 1):
            # the longest piece first, so that it stays on equal sums; the byte piece last
            for width, (hashes, scores, numbers) in vocabulary.by_length.items():
                if width > j:
                    continue
                own = prefix[j] - prefix[j - width] * powers[width - 1]
                place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                hit = np.flatnonzero(hashes[place] == own)
                if len(hit):
                    total = best[j - width, hit] + scores[place[hit]]
                    better = total > best[j, hit]
                    hit, total = hit[better], total[better]
                    best[j, hit], back[j, hit], piece[j, hit] = total, j - width, numbers[place[hit]]
            total = best[j - 1] + vocabulary.byte_score
            better = total > best[j]
            best[j, better], back[j, better] = total[better], j - 1
            piece[j, better] = vocabulary.byte_ids[data[better, j - 1]]
        sums[which] = best[length]
        at = np.full(n, length)
        lanes, steps, found = np.arange(n), [], []
        while len(lanes):
            steps.append(lanes)
            found.append(piece[at[lanes], lanes])
            at[lanes] = back[at[lanes], lanes]
            lanes = lanes[at[lanes] > 0]
        lane, value = np.concatenate(steps[::-1]), np.concatenate(found[::-1])
        order = np.argsort(lane, kind="stable")
        for k, own in zip(which, np.split(value[order], np.cumsum(np.bincount(lane, minlength=n))[:-1]), strict=True):
            ids[k] = own
    return ids, sums


def _traced(last: dict, at: int) -> np.ndarray:
    out = []
    while last[at] is not None:
        at, piece = last[at]
        out.append(piece)
    return np.array(out[::-1], np.int32)


def encode_texts(texts: Texts, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece ids of all texts one after the other, how many each text has, sums of scores. Every text is " " and its bytes."""
    n = texts.n
    data = np.full(len(texts.data) + n, SPACE, np.uint8)
    shift = np.repeat(np.arange(1, n + 1), np.diff(texts.bounds))
    data[np.arange(len(texts.data)) + shift] = texts.data
    starts = np.flatnonzero(data == SPACE)
    ends = np.append(starts[1:], len(data))
    bounds = texts.bounds + np.arange(n + 1)
    _, first, which = np.unique(Rolling(data).of(starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    found, sums = encode_units([raw[a:b] for a, b in zip(starts[first], ends[first], strict=True)], vocabulary)
    size = np.array([len(x) for x in found], np.int64)
    flat = np.concatenate([*found, np.zeros(0, np.int32)])
    offset = np.cumsum(size) - size
    count = size[which]
    at = np.repeat(offset[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    row = np.searchsorted(bounds, starts, side="right") - 1
    return flat[at], np.bincount(row, count, minlength=n).astype(np.int64), np.bincount(row, sums[which], minlength=n).astype(np.int64)


class Decoder:
    """The bytes of pieces, one after the other."""

    def __init__(self, vocabulary: Pieces):
        self.length = np.array([len(b) for b in vocabulary.bytes_of], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(vocabulary.bytes_of), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.data[np.repeat(self.first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


# ------------------------------------------------------------------ giant texts


def _units(data: bytes, vocabulary: Pieces) -> tuple[np.ndarray, int]:
    """Ids and sum of bytes that begin with a space, or of none."""
    if not data:
        return np.zeros(0, np.int32), 0
    units = [b" " + u for u in data[1:].split(b" ")]
    distinct = {u: k for k, u in enumerate(dict.fromkeys(units))}
    found, sums = encode_units(list(distinct), vocabulary)
    order = [distinct[u] for u in units]
    return np.concatenate([found[k] for k in order]), int(sums[order].sum())


def _spaces(data: bytes, size: int) -> tuple[int, int] | None:
    """The first and the last space among the first ``size`` bytes. No piece crosses a space, so all paths meet there."""
    head = data.find(b" ", 0, size)
    return None if head < 0 else (head, data.rfind(b" ", 0, size))


def transfer(data: bytes, size: int, vocabulary: Pieces) -> np.ndarray:
    """Best sums from each state at the left edge to each at the right edge of a chunk: its ``size`` bytes, and the next ones."""
    states = vocabulary.longest
    matrix = np.full((states, states), _LOW, np.int64)
    spaces = _spaces(data, size)
    if spaces is None:
        for s in range(min(states, size + 1)):
            best, _ = best_path(data, {s: 0}, vocabulary, size)
            for e in range(states):
                matrix[s, e] = best.get(size + e, _LOW)
        return matrix
    head, tail = spaces
    _, middle = _units(data[head:tail], vocabulary)
    right, _ = best_path(data[tail:], {0: 0}, vocabulary, size - tail)
    for s in range(min(states, head + 1)):
        left, _ = best_path(data[:head], {s: 0}, vocabulary, head)
        for e in range(states):
            if head in left and size - tail + e in right:
                matrix[s, e] = left[head] + middle + right[size - tail + e]
    return matrix


def _from_edge(edge: np.ndarray) -> dict[int, int]:
    return {s: int(v) for s, v in enumerate(edge) if v > _LOW // 2}


def _start_of(last: dict, at: int) -> int:
    while last[at] is not None:
        at = last[at][0]
    return at


def edge_map(data: bytes, size: int, edge: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """The state at the left edge that the best path to each state at the right edge comes from; -1 where there is none.
    ``edge`` has the best sums up to the states at the left edge."""
    spaces = _spaces(data, size)
    if spaces:
        _, last = best_path(data[: spaces[0]], _from_edge(edge), vocabulary, spaces[0])
        return np.full(len(edge), _start_of(last, spaces[0]))
    _, last = best_path(data, _from_edge(edge), vocabulary, size)
    return np.array([_start_of(last, size + e) if size + e in last else -1 for e in range(len(edge))])


def trace(data: bytes, size: int, edge: np.ndarray, right: int, vocabulary: Pieces) -> np.ndarray:
    """Ids of the pieces that start in a chunk, where the path ends in the state ``right``."""
    spaces = _spaces(data, size)
    if spaces is None:
        _, last = best_path(data, _from_edge(edge), vocabulary, size)
        return _traced(last, size + right)
    head, tail = spaces
    _, left = best_path(data[:head], _from_edge(edge), vocabulary, head)
    _, end = best_path(data[tail:], {0: 0}, vocabulary, size - tail)
    middle, _ = _units(data[head:tail], vocabulary)
    return np.concatenate([_traced(left, head), middle, _traced(end, size - tail + right)])


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two transfer matrices: the best sums over both chunks."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), _LOW)


def _edges_of(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Best sums at the left edge of each chunk, and at the end of the text."""
    states = len(matrices[0])
    edge = np.full((1, states), _LOW, np.int64)
    edge[0, 0] = 0
    found = [edge[0]]
    for m in matrices:
        edge = max_plus(edge, m)
        found.append(edge[0])
    return found


def _giants(rows: DataFrame, vocabulary, chunk: int) -> DataFrame:
    """Encodings of giant texts (``id``, ``text``): ``id``, ``ids``, ``score``."""
    kind = dict(rows.dtypes)["id"]

    def cut(batches):
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 32
        reach = vocabulary.value.longest - 1
        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                data = b" " + text.as_py().encode()
                for k, at in enumerate(range(0, len(data), chunk)):
                    size = min(chunk, len(data) - at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key], pa.int64()),
                            pa.array([id_.as_py()], batch.schema.field(0).type),
                            pa.array([k], pa.int32()),
                            pa.array([size], pa.int32()),
                            pa.array([data[at : at + size + reach]], pa.binary()),
                        ],
                        names=["key", "id", "k", "size", "data"],
                    )
                key += 1

    chunks = stage(rows.mapInArrow(cut, f"key long, id {kind}, k int, size int, data binary"))

    def matrices(frames):
        for frame in frames:
            made = [transfer(d, s, vocabulary.value).tobytes() for d, s in zip(frame["data"], frame["size"], strict=True)]
            yield pd.DataFrame({"key": frame["key"], "k": frame["k"], "matrix": made})

    def forward(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        states = vocabulary.value.longest
        found = _edges_of([np.frombuffer(m, np.int64).reshape(states, states) for m in group["matrix"]])
        score = int(found[-1][0])
        return pd.DataFrame({"key": group["key"], "k": group["k"], "edge": [e.tobytes() for e in found[:-1]], "score": score})

    def maps(frames):
        for frame in frames:
            columns = zip(frame["data"], frame["size"], frame["edge"], strict=True)
            made = [edge_map(d, s, np.frombuffer(e, np.int64), vocabulary.value).tobytes() for d, s, e in columns]
            yield pd.DataFrame({"key": frame["key"], "k": frame["k"], "map": made})

    def backward(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k", ascending=False)
        state, found = 0, []
        for m in group["map"]:
            found.append(state)
            state = int(np.frombuffer(m, np.int64)[state])
        return pd.DataFrame({"key": group["key"], "k": group["k"], "right": found})

    def traces(frames):
        for frame in frames:
            columns = zip(frame["data"], frame["size"], frame["edge"], frame["right"], strict=True)
            made = [trace(d, s, np.frombuffer(e, np.int64), r, vocabulary.value).tobytes() for d, s, e, r in columns]
            yield pd.DataFrame({"key": frame["key"], "id": frame["id"], "k": frame["k"], "score": frame["score"], "ids": made})

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        ids = np.frombuffer(b"".join(group["ids"]), np.int32)
        return pd.DataFrame({"id": [group["id"].iloc[0]], "ids": [ids], "score": [group["score"].iloc[0]]})

    steps = chunks.mapInPandas(matrices, "key long, k int, matrix binary")
    edges_ = stage(steps.groupBy("key").applyInPandas(forward, "key long, k int, edge binary, score long"))
    edged = chunks.join(edges_, ["key", "k"])
    rights = stage(edged.mapInPandas(maps, "key long, k int, map binary").groupBy("key").applyInPandas(backward, "key long, k int, right int"))
    traced = edged.join(rights, ["key", "k"]).mapInPandas(traces, f"key long, id {kind}, k int, score long, ids binary")
    return traced.groupBy("key").applyInPandas(whole, f"id {kind}, ids array<int>, score long")


def encode(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_file: str = MODEL, chunk: int = CHUNK_BYTES, vocabulary: Pieces | None = None
) -> DataFrame:
    """Id, ``ids`` (array of piece numbers), ``score`` (sum of scores) of each document.

    Texts of more than ``chunk`` bytes go through the chunked scan; the outcome is the same for any ``chunk``. A NULL or empty
    text is the one space before it. Rows with equal ids are encoded each on its own; an empty table gives no rows; other
    columns are not read.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary or Pieces(model_file))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), whole.alias("text"))

    def short(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        flat, count, sums = encode_texts(texts, vocabulary.value)
        offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
        ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(sums, pa.int64())], names=["id", "ids", "score"])

    small = rows.where(F.octet_length("text") <= chunk)
    encoded = by_slices(small, "text", short, f"id {dict(rows.dtypes)['id']}, ids array<int>, score long", 4 << 20)
    giants = rows.where(F.octet_length("text") > chunk)
    if not giants.isEmpty():
        encoded = encoded.unionByName(_giants(giants, vocabulary, chunk))
    return encoded.withColumnRenamed("id", doc_id)


def decode(encoded: DataFrame, ids: str = "ids", model_file: str = MODEL, vocabulary: Pieces | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its pieces; NULL for NULL."""
    decoder = encoded.sparkSession.sparkContext.broadcast(Decoder(vocabulary or Pieces(model_file)))
    place = encoded.columns.index(ids)

    def run(batches):
        for batch in batches:
            column = batch.column(place)
            count = np.diff(column.offsets.to_numpy())
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(count) // (1 << 20))) + 1, [batch.num_rows]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                own = part.column(place)
                n = np.diff(own.offsets.to_numpy())
                first = own.offsets[0].as_py()
                flat = own.values.to_numpy()[first : first + n.sum()]
                data = decoder.value(flat)
                bytes_ = np.concatenate([[0], np.cumsum(decoder.value.length[flat])])
                edges_ = bytes_[np.concatenate([[0], np.cumsum(n)])]
                raw = data.tobytes()
                texts = [raw[x + 1 : y] for x, y in zip(edges_[:-1], edges_[1:], strict=True)]
                made = pa.array([t if v else None for t, v in zip(texts, own.is_valid().to_pylist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made.cast(pa.string())], names=[*batch.schema.names, "decoded"])

    from pyspark.sql import types as T

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
