"""The exact likelihood of ARMA models, by a Kalman filter that is an associative scan.

A stretch of a series is an element: how its last state depends on the state before it (mean ``a`` x + ``b``, covariance
``c``), and the logarithm of the density of its values given that state (``const`` + ``eta``'x - x'``j``x / 2). Two successive
elements combine into one (Saerkkae and Garcia-Fernandez 2021), so stretches are filtered side by side and put together in a
tree. Inside a block all elements of a level share their matrices, which leaves a few products of whole arrays per level.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from regionloom.session import stage

#: Elements that meet at a node of the tree over blocks.
FAN = 64
MOST_STEPS = 40
_STENCIL = 1e-3
_REACH = (1.0, 0.5, 0.25, 0.1, 0.02)


@dataclass
class Element:
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    eta: np.ndarray
    j: np.ndarray
    shape: float  # part of the constant that does not depend on the values
    fit: float  # part that does

    def packed(self) -> list[float]:
        return [*self.a.ravel(), *self.b, *self.c.ravel(), *self.eta, *self.j.ravel(), self.shape, self.fit]

    @staticmethod
    def unpacked(values, r: int) -> Element:
        v = np.asarray(values, float)
        cuts = np.cumsum([r * r, r, r * r, r, r * r])
        a, b, c, eta, j = np.split(v[:-2], cuts[:-1])
        return Element(a.reshape(r, r), b, c.reshape(r, r), eta, j.reshape(r, r), v[-2], v[-1])


def combined(one: Element, two: Element) -> Element:
    """The stretch of ``one`` followed by that of ``two``; ``b``, ``eta`` and ``fit`` may be arrays of many stretches."""
    unit = np.eye(len(one.a))
    d = np.linalg.inv(unit + one.c @ two.j)
    eta2, b1 = two.eta, one.b
    dc, mj = d @ one.c, d.T @ two.j
    return Element(
        two.a @ d @ one.a,
        (b1 + eta2 @ one.c.T) @ (two.a @ d).T + two.b,
        two.a @ dc @ two.a.T + two.c,
        (eta2 - b1 @ two.j.T) @ d @ one.a + one.eta,
        one.a.T @ mj @ one.a + one.j,
        one.shape + two.shape - 0.5 * np.linalg.slogdet(unit + one.c @ two.j)[1],
        one.fit + two.fit + ((eta2 @ d) * b1).sum(-1) - 0.5 * ((b1 @ mj) * b1).sum(-1) + 0.5 * ((eta2 @ dc) * eta2).sum(-1),
    )


def matrices(phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition and noise loading of the state space form whose first state is the value."""
    r = max(len(phi), len(theta) + 1)
    t = np.zeros((r, r))
    t[: len(phi), 0] = phi
    t[np.arange(r - 1), np.arange(1, r)] = 1
    load = np.zeros(r)
    load[0], load[1 : len(theta) + 1] = 1, theta
    return t, load


def block_element(w: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> Element:
    """Element of a stretch of values, for noise of variance one."""
    t, load = matrices(phi, theta)
    first = t[0]
    seen = np.eye(len(t))
    seen[:, 0] -= load
    level = Element(seen @ t, w[:, None] * load, np.zeros_like(t), w[:, None] * first, np.outer(first, first), -0.5 * math.log(2 * math.pi), -0.5 * w * w)
    tails = []
    while len(level.fit) > 1:
        n = len(level.fit)
        part = lambda rows: Element(level.a, level.b[rows], level.c, level.eta[rows], level.j, level.shape, level.fit[rows])  # noqa: E731,B023
        if n % 2:
            tails.append(part(n - 1))
        level = combined(part(slice(0, n - n % 2, 2)), part(slice(1, n - n % 2, 2)))
    whole = Element(level.a, level.b[0], level.c, level.eta[0], level.j, level.shape, level.fit[0])
    for tail in reversed(tails):
        whole = combined(whole, tail)
    return whole


def from_start(element: Element, phi: np.ndarray, theta: np.ndarray) -> Element:
    """The element after the stationary distribution of the state: ``b`` and ``c`` are the state at the end."""
    t, load = matrices(phi, theta)
    r = len(t)
    spread = np.linalg.solve(np.eye(r * r) - np.kron(t, t), np.outer(load, load).ravel()).reshape(r, r)
    zero = np.zeros((r, r))
    return combined(Element(zero, np.zeros(r), (spread + spread.T) / 2, np.zeros(r), zero, 0.0, 0.0), element)


def deviance(element: Element, phi: np.ndarray, theta: np.ndarray, n: int) -> tuple[float, float]:
    """-2 log likelihood at the best noise variance, and that variance."""
    whole = from_start(element, phi, theta)
    variance = max(-2 * whole.fit / n, 1e-300)
    return float(-2 * whole.shape + n * math.log(variance) + n), float(variance)


def coefficients(u: np.ndarray) -> np.ndarray:
    """Autoregressive coefficients of a stationary model from free numbers (partial autocorrelations u / sqrt(1 + u^2))."""
    phi = np.zeros(0)
    for partial in np.asarray(u) / np.sqrt(1 + np.asarray(u) ** 2):
        phi = np.append(phi - partial * phi[::-1], partial)
    return phi


def free_numbers(phi: np.ndarray) -> np.ndarray:
    """The inverse; what is not stationary is pulled inside."""
    phi, partials = np.array(phi, float), []
    while len(phi):
        partial = float(np.clip(phi[-1], -0.95, 0.95))
        partials.append(partial)
        phi = (phi[:-1] + partial * phi[:-1][::-1]) / (1 - partial**2)
    partials = np.array(partials[::-1])
    return partials / np.sqrt(1 - partials**2)


@dataclass
class Model:
    """Orders, and whether a mean is fitted; ``u`` is the mean (if any), then the free numbers of both parts."""

    p: int
    q: int
    mean: bool

    @property
    def states(self) -> int:
        return max(self.p, self.q + 1)

    def parts(self, u) -> tuple[float, np.ndarray, np.ndarray]:
        u = np.asarray(u, float)
        level, rest = (u[0], u[1:]) if self.mean else (0.0, u)
        return float(level), coefficients(rest[: self.p]), -coefficients(rest[self.p :])

    def element(self, w: np.ndarray, u) -> Element:
        level, phi, theta = self.parts(u)
        return block_element(w - level, phi, theta)

    def deviance(self, element: Element, u, n: int) -> tuple[float, float]:
        _, phi, theta = self.parts(u)
        return deviance(element, phi, theta, n)


def stencil(u: np.ndarray) -> list[np.ndarray]:
    """Points whose values give the gradient and the curvature at the first one."""
    steps = np.eye(len(u)) * _STENCIL
    points = [u, *(u + s for s in steps), *(u - s for s in steps)]
    return points + [u + steps[i] + steps[j] for i in range(len(u)) for j in range(i)]


def direction(u: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Newton's step, against the gradient also where the curvature is not positive."""
    m, h = len(u), _STENCIL
    up, down = values[1 : m + 1], values[m + 1 : 2 * m + 1]
    gradient = (up - down) / (2 * h)
    curve = np.diag((up - 2 * values[0] + down) / h**2)
    at = 2 * m + 1
    for i in range(m):
        for j in range(i):
            curve[i, j] = curve[j, i] = (values[at] - up[i] - up[j] + values[0]) / h**2
            at += 1
    sizes, axes = np.linalg.eigh(curve)
    sizes = np.maximum(np.abs(sizes), 1e-6 * max(np.abs(sizes).max(), 1e-6))
    step = -axes @ ((axes.T @ gradient) / sizes)
    return step * min(1.0, 2.0 / max(np.linalg.norm(step), 1e-12))


def candidates(u: np.ndarray, step: np.ndarray) -> list[np.ndarray]:
    return [u + s * step for s in _REACH]


def settled(before: float, after: float) -> bool:
    return not after < before - 1e-9 * (1 + abs(before))


def forecast_parts(model: Model, u, element: Element, steps: int, differences: int, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts of the undifferenced series after the last values ``past``, and their variances for noise of variance one."""
    level, phi, theta = model.parts(u)
    t, load = matrices(phi, theta)
    end = from_start(element, phi, theta)
    reach, loads, row = [], [], np.eye(len(t))[0]
    for _ in range(steps):
        loads.append(row @ load)
        row = row @ t
        reach.append(row)
    reach, loads = np.array(reach), np.array(loads)
    values = level + reach @ end.b
    for k in range(differences, 0, -1):
        values = np.cumsum(values) + np.diff(past, k - 1)[-1]
        reach, loads = np.cumsum(reach, axis=0), np.cumsum(loads)
    return values, np.einsum("hr,rs,hs->h", reach, end.c, reach) + np.cumsum(loads**2)


def fitted(w: np.ndarray, model: Model, u: np.ndarray) -> tuple[np.ndarray, float]:
    """Free numbers of the greatest likelihood of one block, and its deviance."""
    value = lambda x: model.deviance(model.element(w, x), x, len(w))[0]
    now = value(u)
    for _ in range(MOST_STEPS if len(u) else 0):
        step = direction(u, np.array([value(x) for x in stencil(u)]))
        tried = candidates(u, step)
        values = [value(x) for x in tried]
        best, before = int(np.argmin(values)), now
        if values[best] < now:
            u, now = tried[best], values[best]
        if settled(before, now):
            break
    return u, now


def _evaluated(blocks: DataFrame, points: DataFrame, model: Model, kind: str, most_blocks: int) -> DataFrame:
    """``key``, ``values`` (deviances at the points of each key), ``element`` of the first point, from blocks put together in a tree."""

    def elements(batches):
        for batch in batches:
            rows = []
            for key, block, w, us in zip(batch["key"], batch["block"], batch["w"], batch["us"], strict=True):
                rows += [(key, block, k, list(u), len(w), model.element(np.asarray(w, float), u).packed()) for k, u in enumerate(us)]
            yield pd.DataFrame(rows, columns=["key", "block", "point", "u", "n", "element"])

    schema = f"key {kind}, block long, point int, u array<double>, n long, element array<double>"

    def together(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        whole = None
        for values in part["element"]:
            one = Element.unpacked(values, model.states)
            whole = one if whole is None else combined(whole, one)
        first = part.iloc[0]
        return pd.DataFrame([[first["key"], first["block"] // FAN, first["point"], list(first["u"]), part["n"].sum(), whole.packed()]], columns=part.columns)

    made = blocks.join(points, "key").select("key", "block", "w", "us").mapInPandas(elements, schema)
    while most_blocks > 1:
        made = made.groupBy("key", "point", F.floor(F.col("block") / FAN).alias("node")).applyInPandas(lambda _, part: together(part), schema)
        most_blocks = -(-most_blocks // FAN)

    def valued(batches):
        for batch in batches:
            yield batch.assign(
                value=[model.deviance(Element.unpacked(e, model.states), u, n)[0] for e, u, n in zip(batch["element"], batch["u"], batch["n"], strict=True)]
            )[["key", "point", "u", "value", "element"]]

    each = made.mapInPandas(valued, f"key {kind}, point int, u array<double>, value double, element array<double>")
    packed = F.sort_array(F.collect_list(F.struct("point", "value")))
    first = F.max_by("element", -F.col("point"))
    return each.groupBy("key").agg(F.transform(packed, lambda x: x["value"]).alias("values"), first.alias("element"))


def likelihood_fits(blocks: DataFrame, starts: DataFrame, model: Model, kind: str) -> DataFrame:
    """``key``, ``n``, ``u``, ``deviance`` and ``element`` at the greatest likelihood of each series.

    ``blocks`` has ``key``, ``block`` (from 0) and ``w`` (the values of the block in order), ``starts`` has ``key`` and
    ``u``. A series of one block is fitted where it lies. Longer ones take the same steps together: each step is a few
    passes over the blocks, whose elements meet in a tree.
    """
    sizes = stage(blocks.groupBy("key").agg(F.count(F.lit(1)).alias("blocks"), (F.max("block") + 1).alias("width"), F.sum(F.size("w")).cast("long").alias("n")))
    outcome = f"key {kind}, n long, u array<double>, deviance double, element array<double>"

    def alone(batches):
        for batch in batches:
            rows = []
            for key, w, u in zip(batch["key"], batch["w"], batch["u"], strict=True):
                w = np.asarray(w, float)
                u, value = fitted(w, model, np.asarray(u, float))
                rows.append((key, len(w), list(u), value, model.element(w, u).packed()))
            yield pd.DataFrame(rows, columns=["key", "n", "u", "deviance", "element"])

    short = blocks.join(sizes.where("blocks = 1").select("key"), "key").join(starts, "key")
    done = stage(short.select("key", "w", "u").mapInPandas(alone, outcome))
    long = sizes.where("blocks > 1")
    most = long.agg(F.max("width")).first()[0]
    if not most:
        return done
    parts = stage(blocks.join(long.select("key"), "key"))
    state = stage(starts.join(long.select("key", "n"), "key").select("key", "n", "u"))
    one = F.array("u").alias("us")
    ends = []
    for _ in range(MOST_STEPS):
        state, over = _step(parts, state, model, kind, most)
        ends.append(over)
        if state.isEmpty():
            break
    else:
        ends.append(state.select("key", "n", "u"))
    settled_rows = ends[0]
    for more in ends[1:]:
        settled_rows = settled_rows.unionByName(more)
    last = _evaluated(parts, settled_rows.select("key", one), model, kind, most)
    final = settled_rows.join(last, "key").select("key", "n", "u", F.get("values", F.lit(0)).alias("deviance"), "element")
    return done.unionByName(final)


def _step(parts: DataFrame, state: DataFrame, model: Model, kind: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Series that moved, with their new free numbers, and those that have settled."""

    def with_points(batches):
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "us": [[list(p) for p in stencil(np.asarray(u, float))] for u in batch["u"]]})

    points = state.select("key", "u").mapInPandas(with_points, f"key {kind}, us array<array<double>>")
    around = stage(state.join(_evaluated(parts, points, model, kind, most).select("key", "values"), "key"))

    def with_candidates(batches):
        for batch in batches:
            tried = []
            for u, values in zip(batch["u"], batch["values"], strict=True):
                u = np.asarray(u, float)
                tried.append([list(p) for p in candidates(u, direction(u, np.asarray(values, float)))])
            yield pd.DataFrame({"key": batch["key"], "us": tried})

    tries = stage(around.select("key", "u", "values").mapInPandas(with_candidates, f"key {kind}, us array<array<double>>"))
    values = _evaluated(parts, tries, model, kind, most).select("key", F.col("values").alias("reached"))
    met = around.join(tries, "key").join(values, "key").withColumn("least", F.array_min("reached"))
    at = F.array_position("reached", F.col("least")).cast("int")
    before = F.get("values", F.lit(0))
    moves = F.col("least") < before - 1e-9 * (1 + F.abs(before))
    nearer = F.when(F.col("least") < before, F.element_at("us", at)).otherwise(F.col("u"))
    met = stage(met.select("key", "n", nearer.alias("u"), F.coalesce(moves, F.lit(False)).alias("moves")))
    return met.where("moves").drop("moves"), met.where("NOT moves").drop("moves")
