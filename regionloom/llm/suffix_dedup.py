"""Removing repeated byte strings across documents, found in suffix order.

A string of ``WIDTH`` bytes that also starts in a document with a smaller id is a repeat. Every window of that width is filed
under its anchor: the leftmost of its 20-byte strings with the smallest hash, which depends on the window alone. The
windows of an anchor lie next to each other; the bytes under them are its stretch. So equal windows have equal anchors,
and where the whole stretches are equal too, all their windows are.

1. Hashes of anchors and stretches, about one in 15 bytes, are packed and dealt to buckets. A stretch that a smaller
   document has too is a repeat as a whole. Stretches that share only the anchor are in question, once each.
2. Each document meets its answers. The bytes of stretches in question are packed and dealt out by anchor.
3. Their suffixes are sorted by the difference cover algorithm (``suffixes``): triples at two of three positions are sorted and
   named, names are sorted again while they repeat, the other suffixes are merged in. Neighbours in that order are compared
   by their first ``WIDTH`` bytes; a class of equal ones has its smallest document.
4. The documents in question meet those answers; bytes under repeated windows go.

Texts travel compressed, once, and once more those in question. No group holds a key's rows: the tasks of 1. send each pair
of hashes once, groups of 2. and 4. are groups of documents by a hash of their ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regionloom.llm.suffixes import equal_prefixes, suffix_array
from regionloom.llm.text import Rolling, Texts, mixed, slices
from regionloom.llm.token_counts import packed, unpacked
from regionloom.session import stage

WIDTH = 50
ANCHOR = 20
GROUP_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
FINER = 8
_NONE = np.uint64((1 << 64) - 1)
_BITS = np.uint64(1)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` entries from each place on."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Stretches:
    """Anchors of some texts: ``low`` to ``high`` are the starts of the windows filed under each, ``row`` its text."""

    def __init__(self, texts: Texts, width: int = WIDTH):
        span = width - ANCHOR + 1
        hashes = Rolling(texts.data)
        keys = hashes.fixed(ANCHOR)
        n = len(texts.data) - width + 1
        empty = np.zeros(0, np.int64)
        self.low = self.high = self.row = empty
        self.key = self.stretch = np.zeros(0, np.uint64)
        if n <= 0:
            return
        row_of = np.repeat(np.arange(texts.n, dtype=np.int32), np.diff(texts.bounds))
        least = _least(keys, span)[:n]
        whole = row_of[:n] == row_of[width - 1 :]
        starts = np.flatnonzero(whole & np.append(True, (least[1:] != least[:-1]) | (row_of[1:n] != row_of[: n - 1])))
        after = np.append(starts[1:], n)
        last = np.minimum(after - 1, texts.bounds[1:][row_of[starts]] - width)
        lows, highs, anchors = [], [], []
        value = least[starts]
        while len(starts):
            at = starts.copy()
            missing = np.flatnonzero(keys[at] != value)
            while len(missing):
                at[missing] += 1
                missing = missing[keys[at[missing]] != value[missing]]
            lows.append(starts)
            highs.append(np.minimum(last, at))
            anchors.append(at)
            more = last > at
            starts, last, value = at[more] + 1, last[more], value[more]
        low, high, at = np.concatenate(lows), np.concatenate(highs), np.concatenate(anchors)
        order = np.argsort(low)
        self.low, self.high, at = low[order], high[order], at[order]
        self.row = row_of[self.low].astype(np.int64)
        self.key = keys[at]
        place = (at - self.low).astype(np.uint64)
        self.stretch = mixed(hashes.of(self.low, self.high + width) + place)


def _five(x: np.ndarray) -> bytes:
    """The upper five bytes of each number."""
    return x.view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _from_five(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 5, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Of an anchor, by bits that its five bytes leave out and some that they keep."""
    return (key & np.uint64(0xFFFFFF)).astype(np.int64) % buckets


def _pair(key: np.ndarray, stretch: np.ndarray, document: np.ndarray) -> np.ndarray:
    upper = np.uint64(0xFFFFFFFFFF000000)
    return mixed(mixed(mixed(key & upper) + (stretch & upper)) + document.view(np.uint64))


def _dealt(part_of: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(part_of, kind="stable")
    cuts = np.searchsorted(part_of[order], np.arange(count + 1))
    return order, cuts, np.flatnonzero(np.diff(cuts))


def _anchors(buckets: int, width: int):
    """Rows ``bucket``, ``keys``, ``stretches``, ``least``, ``documents``: one entry for each pair of hashes of a document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = Stretches(Texts(part.column(1)), width)
                if not len(found.low):
                    continue
                document = part.column(0).to_numpy()[found.row]
                _, once = np.unique(_pair(found.key, found.stretch, document), return_index=True)
                key, stretch, document = found.key[once], found.stretch[once], document[once]
                order, cuts, used = _dealt(_bucket(key, buckets), buckets)
                pieces = [order[cuts[b] : cuts[b + 1]] for b in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int32()),
                        pa.array([_five(key[o]) for o in pieces], pa.binary()),
                        pa.array([_five(stretch[o]) for o in pieces], pa.binary()),
                        pa.array([int(document[o].min()) for o in pieces], pa.int64()),
                        pa.array([packed((document[o] - document[o].min()).view(np.uint64)) for o in pieces], pa.binary()),
                    ],
                    names=["bucket", "keys", "stretches", "least", "documents"],
                )

    return run


def _group_of(document: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(document.view(np.uint64) + np.uint64(7)) % np.uint64(groups)).astype(np.int64)


def _answers(groups: int):
    """For a bucket: by groups of documents, pairs whose whole stretch is a repeat, and pairs in question."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([_from_five(x) for x in rows["keys"]])
        stretch = np.concatenate([_from_five(x) for x in rows["stretches"]])
        document = np.concatenate([unpacked(x) + a for x, a in zip(rows["documents"], rows["least"], strict=True)])
        order = np.lexsort((document, stretch, key))
        key, stretch, document = key[order], stretch[order], document[order]
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, stretch[1:] != stretch[:-1])
        owner = document[np.flatnonzero(new)][np.cumsum(new) - 1]
        repeat = document > owner
        several = np.bincount(np.cumsum(new_key) - 1, new)[np.cumsum(new_key) - 1] > 1
        firsts = np.minimum.reduceat(document, np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
        lasts = np.maximum.reduceat(document, np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
        asked = several & (document == owner) & (firsts < lasts)
        chosen = np.flatnonzero(repeat | asked)
        pair = _pair(key[chosen], stretch[chosen], document[chosen])
        order, cuts, used = _dealt(_group_of(document[chosen], groups), groups)
        pieces = [order[cuts[g] : cuts[g + 1]] for g in used]
        return pd.DataFrame(
            {
                "g": used.astype(np.int64),
                "repeats": [pair[o][repeat[chosen][o]].tobytes() for o in pieces],
                "asked": [pair[o][~repeat[chosen][o]].tobytes() for o in pieces],
            }
        )

    return run


def _kept(data: np.ndarray, windows: np.ndarray, width: int) -> tuple[int, int, str]:
    """Bytes removed, runs of them, hash of the rest; ``windows`` marks the starts of repeated windows."""
    cover = np.zeros(len(data) + 1, np.int32)
    at = np.flatnonzero(windows)
    cover[at] += 1
    np.subtract.at(cover, at + width, 1)
    gone = np.cumsum(cover[:-1]) > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()


_OUT = ["kind", "g", "id", "n_bytes", "n_removed", "n_spans", "sha", "data", "windows", "pairs", "lows"]
_SCHEMA = (
    "kind int, g long, id long, n_bytes long, n_removed long, n_spans long, sha string, data binary, windows binary, pairs binary, lows binary"
)


def _first_answers(buckets: int, width: int):
    """A group of documents with its answers: finished documents (kind 0), documents in question (1), stretches in question (2)."""

    def run(key: tuple, documents: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if documents.empty:
            return pd.DataFrame({c: [] for c in _OUT})
        raw = [pa.decompress(x, n, codec="zstd", asbytes=True) if n else b"" for x, n in zip(documents["data"], documents["n_bytes"], strict=True)]
        texts = Texts(pa.array(raw, pa.binary()).cast(pa.large_binary()).cast(pa.large_string()))
        ids = documents["id"].to_numpy(np.int64)
        found = Stretches(texts, width)
        pair = _pair(found.key, found.stretch, ids[found.row])
        windows = np.zeros(len(texts.data) + 1, np.int32)
        whole = np.isin(pair, np.frombuffer(b"".join(answers["repeats"]), np.uint64))
        np.add.at(windows, found.low[whole], 1)
        np.subtract.at(windows, found.high[whole] + 1, 1)
        marked = np.cumsum(windows[:-1]) > 0
        asked = np.flatnonzero(np.isin(pair, np.frombuffer(b"".join(answers["asked"]), np.uint64)))
        out: list[tuple] = []
        cuts = np.searchsorted(found.row[asked], np.arange(texts.n + 1))
        for i in range(texts.n):
            a, b = texts.bounds[i], texts.bounds[i + 1]
            own = asked[cuts[i] : cuts[i + 1]]
            if len(own):
                bits = pa.compress(np.packbits(marked[a:b]).tobytes(), codec="zstd", asbytes=True)
                out.append((1, key[0], ids[i], b - a, 0, 0, None, documents["data"].iloc[i], bits, pair[own].tobytes(), (found.low[own] - a).tobytes()))
            else:
                out.append((0, key[0], ids[i], b - a, *_kept(texts.data[a:b], marked[a:b], width), None, None, None, None))
        _, once = np.unique(pair[asked], return_index=True)
        asked = asked[once]
        order, cuts, used = _dealt(_bucket(found.key[asked], buckets), buckets)
        for bucket in used:
            own = asked[order[cuts[bucket] : cuts[bucket + 1]]]
            length = found.high[own] + width - found.low[own]
            at = np.repeat(found.low[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            numbers = np.column_stack([pair[own].view(np.int64), ids[found.row[own]], length]).tobytes()
            out.append((2, int(bucket), 0, 0, 0, 0, None, texts.data[at].tobytes(), None, numbers, None))
        return pd.DataFrame(out, columns=_OUT)

    return run


def _compared(groups: int, width: int):
    """Stretches of a bucket: windows of each that a smaller document has, as bits from its first window on."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(b"".join(rows["data"]), np.uint8)
        numbers = np.frombuffer(b"".join(rows["pairs"]), np.int64).reshape(-1, 3)
        pair, document, length = numbers[:, 0], numbers[:, 1], numbers[:, 2]
        n = len(length)
        first = np.cumsum(length) - length
        stretch = np.repeat(np.arange(n), length)
        # one letter of its own ends each stretch, so that no suffix runs on into the next one
        letters = np.empty(len(data) + n, np.int64)
        place = np.arange(len(data)) + stretch
        letters[place] = data.astype(np.int64) + 1
        letters[first + length + np.arange(n)] = 257 + np.arange(n)
        order = suffix_array(letters)
        back = np.full(len(letters), -1)
        back[place] = np.arange(len(data))
        order = back[order]
        order = order[order >= 0]
        within = order - first[stretch[order]]
        order = order[within + width <= length[stretch[order]]]
        same = equal_prefixes(data, order, width)
        class_ = np.cumsum(~same) - 1
        least = np.full(int(class_[-1]) + 1 if len(class_) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, class_, document[stretch[order]])
        hit = order[least[class_] < document[stretch[order]]]
        bits = np.zeros(n, np.uint64)
        np.bitwise_or.at(bits, stretch[hit], _BITS << (hit - first[stretch[hit]]).astype(np.uint64))
        some = np.flatnonzero(bits)
        order, cuts, used = _dealt(_group_of(document[some], groups), groups)
        pieces = [some[order[cuts[g] : cuts[g + 1]]] for g in used]
        return pd.DataFrame(
            {"g": used.astype(np.int64), "pairs": [pair[o].tobytes() for o in pieces], "bits": [bits[o].tobytes() for o in pieces]}
        )

    return run


def _last_answers(width: int):
    def run(key: tuple, documents: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        pairs = np.frombuffer(b"".join(answers["pairs"]), np.uint64)
        bits = np.frombuffer(b"".join(answers["bits"]), np.uint64)
        order = np.argsort(pairs)
        pairs, bits = pairs[order], bits[order]
        out = []
        for row in documents.itertuples():
            data = np.frombuffer(pa.decompress(row.data, row.n_bytes, codec="zstd", asbytes=True), np.uint8)
            marked = np.unpackbits(np.frombuffer(pa.decompress(row.windows, -(-row.n_bytes // 8), codec="zstd", asbytes=True), np.uint8))
            marked = marked[: row.n_bytes].astype(bool)
            own, low = np.frombuffer(row.pairs, np.uint64), np.frombuffer(row.lows, np.int64)
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
                hit = np.flatnonzero(pairs[at] == own)
                for k in range(width - ANCHOR + 1):
                    marked[low[hit[(bits[at[hit]] >> np.uint64(k)) & _BITS > 0]] + k] = True
            out.append((row.id, row.n_bytes, *_kept(data, marked, width)))
        return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _zipped(groups: int):
    """Documents with their groups and compressed bytes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data = [x.encode() for x in part.column(1).to_pylist()]
                blobs = [pa.compress(x, codec="zstd", asbytes=True) if x else b"" for x in data]
                group = _group_of(part.column(0).to_numpy(), groups)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group), part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(blobs, pa.binary())],
                    names=["g", "id", "n_bytes", "data"],
                )

    return run


def repeated_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """For each document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of what is left of its UTF-8 bytes.

    Bytes go that are covered by a string of ``width`` bytes which also starts in a document with a smaller id; strings are
    judged on the input. Matches do not cross documents. Ids are whole numbers; a NULL id is larger than all others (and
    comes back as NULL); documents with equal ids do not remove each other's bytes. NULL is an empty text. An empty table
    gives no rows; other columns are not read.
    """
    largest = (1 << 63) - 1
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(largest)).alias("id"), whole.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = max(8, -(-size // (2 * BUCKET_BYTES))), max(8, -(-size // GROUP_BYTES))
    entries = rows.mapInArrow(_anchors(buckets, width), "bucket int, keys binary, stretches binary, least long, documents binary")
    answers = stage(entries.groupBy("bucket").applyInPandas(_answers(groups), "g long, repeats binary, asked binary"))
    zipped = rows.mapInArrow(_zipped(groups), "g long, id long, n_bytes long, data binary")
    # sorting suffixes takes many times their bytes, so stretches in question are dealt out finer
    first = zipped.groupBy("g").cogroup(answers.groupBy("g")).applyInPandas(_first_answers(FINER * buckets, width), _SCHEMA)
    first = stage(first)
    asked = first.where("kind = 2").groupBy("g").applyInPandas(_compared(groups, width), "g long, pairs binary, bits binary")
    asked = stage(asked)
    open_ = first.where("kind = 1").select("g", "id", "n_bytes", "data", "windows", "pairs", "lows")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    last = open_.groupBy("g").cogroup(asked.groupBy("g")).applyInPandas(_last_answers(width), schema)
    done = first.where("kind = 0").select("id", "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"))
    return done.union(last).withColumn("id", F.when(F.col("id") != largest, F.col("id"))).withColumnRenamed("id", doc_id)
