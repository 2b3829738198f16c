"""NN-descent against brute force, with few and with very many links, and on odd rows."""

import numpy as np
import pytest

from regionloom.llm import near_vectors as module
from regionloom.llm.near_vectors import near_vectors

SCHEMA = "vec_id long, embedding array<float>, a int, b int, v int, vec int, root int"


def brute_force(ids, x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= module.THRESHOLD
    component = np.array(ids)
    while True:
        least = np.array([component[row].min() for row in linked])
        if (least == component).all():
            break
        component = least
    return {i: (int(row.sum()) - 1, int(c)) for i, row, c in zip(ids, linked, component, strict=True)}


def found(spark, ids, x):
    df = spark.createDataFrame([(int(i), [float(c) for c in v], 1, 2, 3, 4, 5) for i, v in zip(ids, x, strict=True)], SCHEMA)
    rows = near_vectors(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


def groups(rng, dim, sizes, noise):
    parts = []
    for n in sizes:
        centre = rng.standard_normal(dim)
        parts.append(centre / np.linalg.norm(centre) + noise / np.sqrt(dim) * rng.standard_normal((n, dim)))
    return np.float32(np.concatenate(parts))


def test_groups_among_many_others(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([groups(rng, 32, [2, 3, 5, 40, 120], 0.15), np.float32(rng.standard_normal((1500, 32)))])
    ids = rng.permutation(len(x)) * 3 + 1
    want, got = brute_force(ids, np.float64(x)), found(spark, ids, x)
    assert got == want


@pytest.mark.parametrize("noise", [0.05, 0.3, 0.45])
def test_group_larger_than_a_block(spark, monkeypatch, noise):
    """Bounds by angle, and blocks in doubt: tight groups, and groups where only some pairs are links."""
    monkeypatch.setattr(module, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(11)
    x = np.concatenate([groups(rng, 16, [300, 3], noise), np.float32(rng.standard_normal((200, 16)))])
    ids = np.arange(len(x))
    assert found(spark, ids, x) == brute_force(ids, np.float64(x))


def test_recall_of_direct_links_is_high_without_exact_counts(spark):
    """The lists themselves hold the links, before components are compared."""
    rng = np.random.default_rng(2)
    x = np.concatenate([groups(rng, 48, [2] * 150, 0.25), np.float32(rng.standard_normal((3000, 48)))])
    ids = np.arange(len(x))
    want, got = brute_force(ids, np.float64(x)), found(spark, ids, x)
    assert sum(got[i][0] for i in ids) >= 0.95 * sum(want[i][0] for i in ids)
    assert all(got[i][0] <= want[i][0] for i in ids)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
        (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-38, 1e-38]), (11, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], SCHEMA)
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10, 11)]
    assert got == sorted([*alone, (7, 3, 7, True), (7, 3, 7, True), (8, 3, 7, False), (-1, 3, 7, False)])


def test_doubles_and_empty_table(spark):
    wide = spark.createDataFrame([(1, [1e300, 1e300]), (2, [1e300, 1.1e300]), (3, [1.0, -1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in near_vectors(wide).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert near_vectors(wide.limit(0)).collect() == []
