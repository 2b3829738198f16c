"""The trie of conversations against brute force, with segments and blocks small enough for many edges."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from regionloom.llm import prefix_trie
from regionloom.llm.prefix_trie import RangeMinima, conversation_trie, shared_turns

FIGURES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda t: hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()
    own = {c: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1], digest(t)))] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    members = {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = sum(saved[q] for q in below) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = {p: ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(p)) for p, cs in members.items()}
    return sorted(
        (min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest())
        for p, cs in members.items()
    )


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("place", "key", "k", "part", "digest"):
        df = df.withColumn(name, df["turn"])
    out = conversation_trie(df)
    assert out.columns == FIGURES
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in out.collect())


def test_range_minima_find_extents_on_their_own():
    random.seed(3)
    values = np.array([random.randrange(4) for _ in range(77)])
    table = RangeMinima(values)
    at, depth = np.repeat(np.arange(77), 3), np.tile([1, 2, 3], 77)
    left, right = table.extents(at, depth)
    for i, d, a, b in zip(at, depth, left, right, strict=True):
        low, high = i, i
        while low > 0 and values[low] >= d:
            low -= 1
        while high + 1 < 77 and values[high + 1] >= d:
            high += 1
        assert (a, b) == (low, high)
    assert all(table.of(np.array([a]), np.array([b]))[0] == values[a : b + 1].min() for a in range(0, 77, 7) for b in range(a, 77, 5))


def test_shared_turns():
    one = bytes(range(16)) * 40
    for n in (0, 1, 5, 39, 40):
        other = one[: 16 * n] + b"x" * 16
        assert shared_turns(one, other) == n


@pytest.mark.parametrize("segment,block", [(256, 1 << 18), (3, 40), (2, 12)])
def test_trie_is_that_of_brute_force(spark, monkeypatch, segment, block):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", block)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    random.seed(segment)
    rows = []
    for c in range(-7, 130):
        for t in range(random.choice([1, 2, 4, 9, 14, 30])):
            # few different texts, so that long heads are shared; some conversations are copies
            text = "same" if c % 3 == 0 and t < 12 else random.choice(["a", "b", "é"])
            rows.append((c, t, random.choice(["user", "user", None]) if c % 3 else "user", text))
    rows += [(500, None, "user", "first"), (500, 1, None, None), (500, 1, "b", "tie"), (500, 1, "a", "tie"), (500, 1, "a", "tie"), (None, 1, "user", "x")]
    rows += [(1000 + i, t, "user", "same") for i in range(60) for t in range(10)]
    assert found(spark, rows) == brute_force(rows)


def test_long_conversation_of_many_segments(spark):
    rows = [(c, t, "user", "same" if t < 700 or c < 2 else f"{c}") for c in range(20, 23) for t in range(1000)]
    assert found(spark, rows) == brute_force(rows)


def test_no_conversations(spark):
    assert found(spark, []) == []
