"""A kernel machine's dual over any number of rows, in the terms of an expansion of the RBF kernel.

In few features the kernel is a short sum of products of functions of one feature each (``expansion``: all products down to
1e-13, so it is the kernel up to rounding). The dual then has an unknown for each term instead of one for each row. The hinge
is rounded off, less and less, and Newton's method follows its minimum (``solved``). At the end the hinge is rounded over
half of the gap asked for, which gives dual variables that violate the conditions by no more than that.

Large tables start from the means of cells. Then rows far from the bend of the hinge enter by their sums, which do not change
while they stay on their side, and only the others are read by each step. All rows are looked at again before each of the first
stages and at the end; if any has changed sides by then, the work goes on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from regionloom.session import drop_stage, stage

#: More terms than this, or a wider table of products, make no saving: the caller solves by working sets.
MOST_TERMS = 2500
_MOST_PRODUCTS = 1 << 18
#: Products below this are rounding errors of a kernel value.
_EXACT = 1e-13
#: Up to so many rows are held by the driver, where a step costs no job.
HELD_ROWS = 1 << 16
#: Newton's matrix is summed over rows up to so many rows on the bend of the hinge; else a stage's first steps take up to so many
#: means of cells for it. The matrix only gives the direction of a step, not where the steps end.
_BENT_ROWS = 1 << 21
_BENT_CELLS = 1 << 18
_CELL_STEPS = 12
#: Cells whose means start large tables.
_CELLS = 1 << 16
_CHUNK = 2048
_PIECE = 1 << 16
#: Rounding of the hinge, as a part of the margin, down to which cells stand for their rows.
_COARSE = 0.05
#: Rows that miss the margin by more than so many times the rounding are far from the bend.
_FAR = 25.0
#: Parts of a step at which its slope is taken.
_PARTS = 2.0 ** np.arange(-16, 4)
_SOFT_PARTS = _PARTS[8:]


@dataclass
class Expansion:
    """For each feature its ends, nodes and map from kernel values at the nodes to functions, and the terms' functions of the
    first and of the other features (``sides``: function numbers and sizes, the greatest first)."""

    gamma: float
    low: np.ndarray
    high: np.ndarray
    nodes: list[np.ndarray]
    maps: list[np.ndarray]
    sides: list[tuple[np.ndarray, np.ndarray]]

    def terms(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Terms greater than ``least`` as numbers on both sides; a smaller ``least`` appends to them."""
        sizes = np.multiply.outer(self.sides[0][1], self.sides[1][1])
        i, j = np.nonzero(sizes > least)
        order = np.argsort(-sizes[i, j], kind="stable")
        return i[order], j[order]

    def values(self, x: np.ndarray, counts: tuple[int, int]) -> list[np.ndarray]:
        """Of each row the first functions of both sides."""
        found, at = [], 0
        for (numbers, _), count in zip(self.sides, counts, strict=True):
            side = np.ones((len(x), count))
            for f in range(numbers.shape[1]):
                used = numbers[:count, f]
                most = int(used.max(initial=0)) + 1
                apart = x[:, at + f, None] - self.nodes[at + f]
                apart *= apart
                apart *= -self.gamma
                side *= (np.exp(apart, out=apart) @ self.maps[at + f][:, :most])[:, used]
            at += numbers.shape[1]
            found.append(side)
        return found


def _functions(low: float, high: float, gamma: float):
    """Nodes, map and mean squares of functions whose products sum up to the kernel of one feature between two ends."""
    n = 16 + int(4 * (high - low) * np.sqrt(gamma))
    while n <= 400:
        nodes = (low + high) / 2 + (high - low) / 2 * np.cos((np.arange(n) + 0.5) * np.pi / n)
        size, vectors = np.linalg.eigh(np.exp(-gamma * (nodes[:, None] - nodes) ** 2))
        size, vectors = size[::-1], vectors[:, ::-1]
        held = size > _EXACT * size[0] / 10
        move = vectors[:, held] / np.sqrt(size[held])
        probe = np.linspace(low, high, 4 * n)
        rest = 1 - ((np.exp(-gamma * (probe[:, None] - nodes) ** 2) @ move) ** 2).sum(axis=1)
        if np.abs(rest).max() < 1e-11:
            return nodes, move, size[held] / n
        n *= 2
    return None


def expansion(low: np.ndarray, high: np.ndarray, gamma: float) -> Expansion | None:
    """The expansion between the ends of each feature, or none where it would be long."""
    found = [_functions(float(a), float(b), gamma) for a, b in zip(low, high, strict=True)]
    if any(f is None for f in found):
        return None
    tops, sides = [f[2][0] for f in found], []
    middle = (len(found) + 1) // 2
    for features in (range(middle), range(middle, len(found))):
        others = np.prod([tops[f] for f in range(len(found)) if f not in features])
        numbers, sizes = np.zeros((1, 0), int), np.ones(1)
        for f in features:
            ahead = others * np.prod([tops[g] for g in features if g > f])
            sizes = np.multiply.outer(sizes, found[f][2])
            i, j = np.nonzero(sizes * ahead > _EXACT)
            if len(i) > _MOST_PRODUCTS:
                return None
            numbers, sizes = np.column_stack([numbers[i], j]), sizes[i, j]
        order = np.argsort(-sizes, kind="stable")
        sides.append((numbers[order], sizes[order]))
    if len(sides[0][1]) * len(sides[1][1]) > _MOST_PRODUCTS:
        return None
    return Expansion(gamma, low, high, [f[0] for f in found], [f[1] for f in found], sides)


def bent(z: np.ndarray, width: float, c: float, soft: bool):
    """Dual variables and their slopes at margins missed by ``z``: the rounded hinge's derivatives."""
    if not soft:
        alpha = np.clip(c / 2 + c / width * z, 0, c)
        return alpha, np.where((alpha > 0) & (alpha < c), c / width, 0.0)
    part = _risen(z, width)
    return c * part, c / width * part * (1 - part)


def _risen(z: np.ndarray, width: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z / width))


@dataclass
class _Place:
    """Coefficients of terms, a constant, and the rounding of the hinge."""

    e: Expansion
    i: np.ndarray
    j: np.ndarray
    coefficients: np.ndarray
    constant: float
    width: float
    c: float
    soft: bool

    def __post_init__(self):
        self.counts = (int(self.i.max()) + 1, int(self.j.max()) + 1)
        self.table = self.tabled(self.coefficients)

    def tabled(self, coefficients: np.ndarray) -> np.ndarray:
        table = np.zeros(self.counts)
        table[self.i, self.j] = coefficients
        return table

    def missed(self, a: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
        return 1 - y * (np.einsum("nk,nk->n", a @ self.table, b) + self.constant)

    def alpha(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        parts = [np.zeros(0)]
        for at in range(0, len(x), _CHUNK):
            a, b = self.e.values(x[at : at + _CHUNK], self.counts)
            parts.append(bent(self.missed(a, b, y[at : at + _CHUNK]), self.width, self.c, self.soft)[0])
        return np.where(y == 0, 0.0, np.concatenate(parts))


class _Slopes:
    """Slopes of the rounded hinges at parts of a step."""

    def __init__(self, place: _Place, step: np.ndarray):
        self.place, self.step, self.constant = place, place.tabled(step[1:]), step[0]
        self.parts = _SOFT_PARTS if place.soft else _PARTS
        self.sums = np.zeros(len(self.parts))

    def add(self, x: np.ndarray, y: np.ndarray, rows) -> None:
        place = self.place
        a, b = place.e.values(x, place.counts)
        z = place.missed(a, b, y)
        moved = -y * (np.einsum("nk,nk->n", a @ self.step, b) + self.constant)
        rise = _risen if place.soft else lambda z, width: np.clip(0.5 + z / width, 0, 1)
        self.sums += [place.c * float(rise(z + t * moved, place.width) @ (moved * rows)) for t in self.parts]

    def result(self) -> np.ndarray:
        return self.sums


class _System:
    """Rows on the bend, sums of dual variables times constant and terms, and Newton's matrix or its weights by cells."""

    def __init__(self, place: _Place, side: int | None):
        self.place, self.side, self.bent = place, side, 0
        self.sums = np.zeros(place.counts)
        self.balance = 0.0
        n = len(place.i) + 1
        self.matrix = np.zeros((n, n)) if side is None else np.zeros((1 + len(place.e.low), side ** len(place.e.low)))
        self.waiting, self.waiting_rows = [], 0

    def add(self, x: np.ndarray, y: np.ndarray, rows) -> None:
        place, e = self.place, self.place.e
        a, b = e.values(x, place.counts)
        alpha, slope = bent(place.missed(a, b, y), place.width, place.c, place.soft)
        signed = alpha * y * rows
        self.balance += float(signed.sum())
        self.sums += a.T @ (b * signed[:, None])
        some = np.flatnonzero(slope > 1e-7 * place.c / place.width)
        slope = (slope * rows)[some]
        self.bent += len(some)
        if self.side is not None:
            cell = _cell(x[some], e, self.side)
            for sums, weights in zip(self.matrix, [slope, *(x[some].T * slope)], strict=True):
                np.add.at(sums, cell, weights)
        elif len(some):
            root = np.sqrt(slope)[:, None]
            self.waiting.append(np.column_stack([root, a[np.ix_(some, place.i)] * b[np.ix_(some, place.j)] * root]))
            self.waiting_rows += len(some)
            if self.waiting_rows >= _CHUNK:
                self._sum()

    def _sum(self) -> None:
        if self.waiting:
            rows = np.concatenate(self.waiting)
            self.matrix += rows.T @ rows
            self.waiting, self.waiting_rows = [], 0

    def result(self) -> np.ndarray:
        self._sum()
        return np.concatenate([[self.bent, self.balance], self.sums[self.place.i, self.place.j], self.matrix.ravel()])


class _Sums:
    """Sums of dual variables, and of them times all products, for the kernel's exact decision sums."""

    def __init__(self, place: _Place):
        self.place, self.counts = place, tuple(len(sizes) for _, sizes in place.e.sides)
        self.sums, self.balance = np.zeros(self.counts), 0.0

    def add(self, x: np.ndarray, y: np.ndarray, rows) -> None:
        a, b = self.place.e.values(x, self.counts)
        signed = self.place.alpha(x, y) * y
        self.balance += float(signed.sum())
        self.sums += a.T @ (b * signed[:, None])

    def result(self) -> np.ndarray:
        return np.append(self.balance, self.sums.ravel())


class _Cells:
    """For each class and cell its rows and the sums of their features."""

    def __init__(self, e: Expansion, side: int):
        self.e, self.side = e, side
        self.sums = np.zeros((1 + len(e.low), 2 * side ** len(e.low)))

    def add(self, x: np.ndarray, y: np.ndarray, rows) -> None:
        cell = 2 * _cell(x, self.e, self.side) + (y > 0)
        for sums, weights in zip(self.sums, [1.0, *x.T], strict=True):
            np.add.at(sums, cell, weights)

    def result(self) -> np.ndarray:
        return self.sums.ravel()


class _Split:
    """Rows near the bend, and the sums of those beyond it; rows as far on its other side have dual variables of 0."""

    def __init__(self, place: _Place, reach: float, counts: tuple[int, int]):
        self.place, self.reach, self.counts = place, reach, counts
        self.sums, self.balance, self.near = np.zeros(counts), 0.0, 0
        self.found = []

    def add(self, x: np.ndarray, y: np.ndarray, rows) -> None:
        place = self.place
        a, b = place.e.values(x, self.counts)
        z = place.missed(a[:, : place.counts[0]], b[:, : place.counts[1]], y)
        near, beyond = np.abs(z) <= self.reach, z > self.reach
        self.balance += place.c * float(y[beyond].sum())
        self.sums += a[beyond].T @ (b[beyond] * (place.c * y[beyond])[:, None])
        self.near += int(near.sum())
        self.found.append((x[near], y[near]))

    def taken(self, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows near the bend since the last call, if they are so many at least."""
        if sum(len(y) for _, y in self.found) < least:
            return []
        found, self.found = self.found, []
        return [(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))] if found else []

    def result(self) -> np.ndarray:
        return np.concatenate([[self.near, self.balance], self.sums.ravel()])


def _cell(x: np.ndarray, e: Expansion, side: int) -> np.ndarray:
    apart = np.where(e.high > e.low, e.high - e.low, 1.0)
    at = np.clip(((x - e.low) / apart * side).astype(np.int64), 0, side - 1)
    return np.ravel_multi_index(tuple(at.T), (side,) * x.shape[1])


def _matrix(place: _Place, sums: np.ndarray) -> np.ndarray:
    """Newton's matrix as if all rows of a cell lay at their weighted mean; ``sums`` of weights and of weighted features."""
    e, n = place.e, len(place.i) + 1
    weights = sums[0]
    cells = np.flatnonzero(weights > 0)
    matrix = np.zeros((n, n))
    for at in range(0, len(cells), 4 * _CHUNK):
        some = cells[at : at + 4 * _CHUNK]
        a, b = e.values((sums[1:, some] / weights[some]).T, place.counts)
        root = np.sqrt(weights[some])[:, None]
        rows = np.column_stack([root, a[:, place.i] * b[:, place.j] * root])
        matrix += rows.T @ rows
    return matrix


def _chunks(x: np.ndarray, y: np.ndarray):
    for at in range(0, len(x), _CHUNK):
        yield x[at : at + _CHUNK], y[at : at + _CHUNK]


class _Held:
    """Rows in the driver, each standing for a number of ``rows``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None):
        self.x, self.y, self.rows = x, y, np.ones(len(y)) if rows is None else rows
        self.near = len(y)

    def total(self, work, size: int) -> np.ndarray:
        for at in range(0, len(self.y), _CHUNK):
            some = slice(at, at + _CHUNK)
            work.add(self.x[some], self.y[some], self.rows[some])
        return work.result()

    def drop(self) -> None:
        pass


_PIECES = "x binary, y binary, piece long, part long, sums binary"


def _record(x=None, y=None, piece=None, part=None, sums=None) -> pa.RecordBatch:
    bytes_of = lambda v: pa.array([None if v is None else v.tobytes()], pa.binary())
    numbers = [pa.array([piece], pa.int64()), pa.array([part], pa.int64())]
    return pa.RecordBatch.from_arrays([bytes_of(x), bytes_of(y), *numbers, bytes_of(sums)], names=["x", "y", "piece", "part", "sums"])


def _summed(work):
    """For ``mapInArrow`` over blocks: the pieces of the work's result in a task, and the rows it takes out."""

    def run(batches):
        part, some = TaskContext.get().partitionId(), False
        take = getattr(work, "taken", lambda least: [])
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                y = np.frombuffer(y.as_buffer())
                for chunk in _chunks(np.frombuffer(x.as_buffer()).reshape(len(y), -1), y):
                    work.add(*chunk, 1.0)
                    some = True
                for rows in take(4 * _CHUNK):
                    yield _record(*rows)
        for rows in take(1):
            yield _record(*rows)
        sums = work.result() if some else np.zeros(0)
        for k, at in enumerate(range(0, len(sums), _PIECE)):
            yield _record(piece=k, part=part, sums=sums[at : at + _PIECE])

    return run


def _together(pieces: DataFrame, size: int) -> np.ndarray:
    def added(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("part")  # in one order, for the same digits
        sums = np.sum([np.frombuffer(v) for v in some["sums"]], axis=0)
        return pd.DataFrame({"piece": some["piece"].iloc[:1], "part": 0, "sums": [sums.tobytes()]})

    found = pieces.where("piece IS NOT NULL").select("piece", "part", "sums")
    if size > _PIECE:
        found = found.groupBy("piece").applyInPandas(added, "piece long, part long, sums binary")
    found = found.toPandas().sort_values(["piece", "part"])
    return np.concatenate([np.sum([np.frombuffer(v) for v in some], axis=0) for _, some in found.groupby("piece")["sums"]])


class _Blocks:
    """Rows in a table of blocks, read again by every step."""

    def __init__(self, table: DataFrame, near: int):
        self.table, self.near = table, near

    @classmethod
    def of(cls, rows: DataFrame, n: int) -> _Blocks:
        def pack(batches):
            for batch in batches:
                if batch.num_rows:
                    yield _record(batch.column("x").flatten().to_numpy(zero_copy_only=False), batch.column("y").to_numpy())

        parts = 4 * rows.sparkSession.sparkContext.defaultParallelism
        return cls(stage(rows.select("x", "y").mapInArrow(pack, _PIECES).repartition(parts)), n)

    def total(self, work, size: int) -> np.ndarray:
        return _together(self.table.select("x", "y").where("x IS NOT NULL").mapInArrow(_summed(work), _PIECES), size)

    def split(self, place: _Place, reach: float, counts: tuple[int, int]):
        """(rows near the bend, sum of the other rows' signed dual variables, and of these times products)."""
        work = _Split(place, reach, counts)
        table = stage(self.table.select("x", "y").where("x IS NOT NULL").mapInArrow(_summed(work), _PIECES))
        sums = _together(table, 2 + work.sums.size)
        data = _Blocks(table, int(sums[0]))
        if data.near <= HELD_ROWS:
            held = table.where("x IS NOT NULL").select("x", "y").toPandas()
            y = np.concatenate([np.zeros(0), *[np.frombuffer(v) for v in held["y"]]])
            x = np.concatenate([np.zeros(0), *[np.frombuffer(v) for v in held["x"]]]).reshape(len(y), -1)
            data.drop()
            data = _Held(x.reshape(len(y), len(place.e.low)), y)
        return data, float(sums[1]), sums[2:].reshape(counts)

    def drop(self) -> None:
        drop_stage(self.table)


def _part(slopes: np.ndarray, start: float) -> float:
    """Part of a step at which its slope, which grows with the part and is ``start`` at none, is about 0."""
    parts = _PARTS[-len(slopes) :]
    whole = slopes[np.flatnonzero(parts == 1)[0]]
    if abs(whole) <= 0.3 * abs(start):
        return 1.0
    beyond = np.flatnonzero(slopes > 0)
    if not len(beyond):
        return float(parts[-1])
    k = beyond[0]
    before, low = (parts[k - 1], slopes[k - 1]) if k else (0.0, start)
    return float(before + (parts[k] - before) * -low / (slopes[k] - low))


def _apart(place: _Place, sums: np.ndarray, side: int) -> float:
    """How far the terms left out move decision sums, against each other, over the middles of up to ``_CELLS`` cells."""
    e, left = place.e, sums.copy()
    left[place.i, place.j] = 0
    cells = np.arange(min(side ** len(e.low), _CELLS))
    x = np.column_stack(np.unravel_index(cells, (side,) * len(e.low)))
    low, high = 0.0, 0.0
    for some, _ in _chunks(e.low + (x + 0.5) / side * (e.high - e.low), cells):
        a, b = e.values(some, sums.shape)
        moved = np.einsum("nk,nk->n", a @ left, b)
        low, high = min(low, float(moved.min())), max(high, float(moved.max()))
    return high - low


def solved(e: Expansion, rows: DataFrame, n: int, c: float, gap: float):
    """(place, sums): where the machine of ``rows`` (``x``, ``y`` of 1 or -1; ``n`` of them) is solved, and the sums of its dual
    variables times all products; none if it takes more than ``MOST_TERMS`` terms."""
    finest = max(1e-5 / np.sqrt(n), _EXACT)
    if len(e.terms(finest)[0]) > MOST_TERMS:
        return None
    side = max(2, int(_CELLS ** (1 / len(e.low)) + 1e-9))
    bent_side = max(2, int(_BENT_CELLS ** (1 / len(e.low)) + 1e-9))
    cells_pay = bent_side ** len(e.low) <= 4 * _BENT_CELLS
    if n <= HELD_ROWS:
        held = rows.select("x", "y").toPandas()
        data = whole = _Held(np.stack(held["x"].to_numpy()), held["y"].to_numpy())
    else:
        data = whole = _Blocks.of(rows, n)
    width, soft, far = 1.0, True, _FAR
    if whole.near > HELD_ROWS and cells_pay:
        work = _Cells(e, side)
        cells = whole.total(work, work.sums.size).reshape(work.sums.shape)
        some = np.flatnonzero(cells[0])
        data = _Held((cells[1:, some] / cells[0, some]).T, np.where(some % 2, 1.0, -1.0), cells[0, some])
    vector = np.zeros(1)  # the constant, then the coefficients
    fixed_balance, fixed = 0.0, None  # sums of rows far from the bend

    def split(place: _Place, reach: float):
        i, j = e.terms(finest)
        if data is not whole:
            data.drop()
        return whole.split(place, reach, (int(i.max()) + 1, int(j.max()) + 1))

    while True:
        i, j = e.terms(max(finest, 1e-5 * width * width if soft else 0.0))
        vector = np.append(vector, np.zeros(len(i) + 1 - len(vector)))
        flat = np.append(0.0, np.ones(len(i)))
        # the table is split again while many rows are near the bend; then these hold until the end
        if whole.near > HELD_ROWS and soft and width <= _COARSE and (fixed is None or data.near > 8 * HELD_ROWS):
            data, fixed_balance, fixed = split(_Place(e, i, j, vector[1:], float(vector[0]), width, c, soft), far * width)
        beyond = np.append(fixed_balance, np.zeros(len(i)) if fixed is None else fixed[i, j])
        on_bend = data.near
        for k in range(60):
            place = _Place(e, i, j, vector[1:], float(vector[0]), width, c, soft)
            by_cells = soft and on_bend > _BENT_ROWS and cells_pay and k < _CELL_STEPS
            work = _System(place, bent_side if by_cells else None)
            found = data.total(work, 2 + len(i) + work.matrix.size)
            on_bend, rest = int(found[0]), found[2 + len(i) :]
            matrix = _matrix(place, rest.reshape(work.matrix.shape)) if by_cells else rest.reshape(len(i) + 1, -1).copy()
            matrix[np.diag_indices_from(matrix)] += np.append(1e-6 * c / width, flat[1:])
            slope = flat * vector - found[1 : 2 + len(i)] - beyond
            step = -np.linalg.solve(matrix, slope)
            start = float(slope @ step)
            work = _Slopes(place, step)
            slopes = data.total(work, len(work.parts)) + (flat * vector - beyond) @ step + work.parts * ((flat * step) @ step)
            vector = vector + _part(slopes, start) * step
            if -start <= (3e-4 * n * c * width if soft else 1e-14 * c):
                break
        if soft:
            soft = width > gap / 4
            width = 0.4 * width if soft else gap / 2
            continue
        place = _Place(e, i, j, vector[1:], float(vector[0]), width, c, False)
        work = _Sums(place)
        found = whole.total(work, 1 + work.sums.size)
        sums = found[1:].reshape(work.counts)
        if fixed is not None and (abs(found[0]) > 1e-6 * c or np.linalg.norm(vector[1:] - sums[i, j]) > gap / 20) and far < 1e4:
            far *= 4  # rows have changed sides
        else:
            finest /= 30
            if _apart(place, sums, side) <= gap / 4 or len(e.terms(finest)[0]) > MOST_TERMS:
                break
        if whole.near > HELD_ROWS:
            data, fixed_balance, fixed = split(place, far * width)
    if data is not whole:
        data.drop()
    whole.drop()
    return place, sums


def decided(place: _Place, sums: np.ndarray):
    """For ``mapInArrow``: dual variables and exact decision sums of rows."""

    def run(batches):
        for batch in batches:
            y = batch.column("y").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            parts = [np.zeros(0)]
            for some, _ in _chunks(x, y):
                a, b = place.e.values(some, sums.shape)
                parts.append(np.einsum("nk,nk->n", a @ sums, b))
            found = [pa.array(place.alpha(x, y)), pa.array(np.concatenate(parts))]
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in ("id", "x", "y")], *found], names=["id", "x", "y", "alpha", "sum"])

    return run
