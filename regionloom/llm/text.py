"""Words, lines and hashes of whole columns of texts at once, as numpy arrays over their UTF-8 bytes.

Everything here runs inside tasks, on slices of an Arrow batch. A slice has whole texts only; its size is bounded unless
a single text is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finishing steps of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Texts of some rows: ``data`` has their bytes, text i is ``data[bounds[i]:bounds[i + 1]]``. NULL is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        self.n = len(column)
        if self.n == 0:
            self.bounds, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
            return
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.n + 1]
        self.bounds = offsets - offsets[0]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]

    def lowered(self) -> Texts:
        """With A-Z in lower case."""
        other = object.__new__(Texts)
        other.n, other.bounds = self.n, self.bounds
        other.data = self.data + (((self.data >= 65) & (self.data <= 90)).astype(np.uint8) << 5)
        return other

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The row of each byte position."""
        return np.searchsorted(self.bounds, positions, side="right") - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of marked bytes; a run ends with its text."""
        n = len(inside)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.zeros(n + 1, bool)
        first[self.bounds[:-1]] = True
        before = np.concatenate([[False], inside[:-1]])
        starts = np.flatnonzero(inside & (~before | first[:n]))
        after = np.concatenate([inside[1:], [False]])
        ends = np.flatnonzero(inside & (~after | np.concatenate([first[1:n], [True]]))) + 1
        return starts, ends

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(~_SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the lines between newlines; every text has one at least."""
        breaks = np.flatnonzero(self.data == 10)
        rows = np.concatenate([np.arange(self.n), self.owner(breaks)])
        starts = np.concatenate([self.bounds[:-1], breaks + 1])
        order = np.lexsort((starts, rows))
        rows, starts = rows[order], starts[order]
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        last = np.append(rows[1:] != rows[:-1], True)
        ends[last] = self.bounds[1:][rows[last]]
        return starts, ends, rows


#: Longest powers that a process keeps.
KEPT_POWERS = 1 << 20
_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, ... base ** (n - 1), modulo 2 ** 64; not to be written to."""
    size = KEPT_POWERS if n <= KEPT_POWERS else n
    found = _kept.get(base)
    if found is None or len(found) < n:
        found = np.full(size, base, np.uint64)
        found[0] = 1
        np.cumprod(found, out=found)
        if size <= KEPT_POWERS:
            _kept[base] = found
    return found[:n]


class Rolling:
    """Hashes of any byte ranges of ``data``, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(int(_BASE), n + 1)[:n], out=self.sums[1:])
        self.inverse = _powers(int(_INVERSE), n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def fixed(self, width: int) -> np.ndarray:
        """Of the ``width`` bytes from each position on."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def runs(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` successive entries of the same row, and the index of the first of each."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mixed(total[at]), at


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, or one row."""
    if batch.num_rows == 0:
        return
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    sizes = np.zeros(batch.num_rows, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + batch.num_rows + 1]
    sizes[:] = np.diff(offsets)
    part = np.cumsum(sizes) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums by row as integers (counts) or floats."""
    total = np.bincount(rows, weights=values, minlength=n)
    return total.astype(np.int64) if values.dtype.kind in "bui" else total


def by_slices(df, text: str, function, schema: str, most: int = SLICE_BYTES):
    """``df`` through ``function(record batch, Texts) -> record batch or list of them``, slice by slice, in Arrow tasks."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, most):
                made = function(part, Texts(part.column(part.schema.get_field_index(text))))
                yield from made if isinstance(made, list) else [made]
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks entries whose key another entry has too."""
    marks = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        marks[order[1:]] |= same
        marks[order[:-1]] |= same
    return marks


def later(keys: np.ndarray) -> np.ndarray:
    """Marks entries whose key an earlier entry has too."""
    marks = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        marks[order[1:]] = keys[order][1:] == keys[order][:-1]
    return marks


def within(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of the same row."""
    return mixed(hashes + mixed(rows.astype(np.uint64) + np.uint64(1)))
