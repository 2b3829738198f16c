"""Suffix sorting by a difference cover, on whole numpy arrays."""

from __future__ import annotations

import numpy as np


def _ranked(*columns: np.ndarray) -> np.ndarray:
    """Names 1, 2, ... of tuples in their order; equal tuples have equal names."""
    bits = [max(1, int(c.max()).bit_length()) for c in columns] if len(columns[0]) else [64]
    if sum(bits) > 63:
        order = np.lexsort(columns[::-1])
        new = np.ones(len(order), bool)
        new[1:] = False
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
    else:
        key = np.zeros(len(columns[0]), np.int64)
        for c, b in zip(columns, bits, strict=True):
            key = (key << b) | c
        order = np.argsort(key)
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return names


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (whole numbers from 1 on) in their order.

    Triples at the positions that are not multiples of three are sorted and named; if names repeat, the string of names is
    sorted by itself. The remaining suffixes are sorted by their first letter and the rank of the next suffix, and both
    lists are merged.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    # an extra sampled position of zeros where n leaves 1, so that the halves stay apart
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names = _ranked(t[sample], t[sample + 1], t[sample + 2])
    if names.max() < len(names):
        order = suffix_array(names)
    else:
        order = np.argsort(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(_ranked(t[rest], rank[rest + 1]))]
    # how many of the rest come before each sampled suffix: against those that leave 1 by one letter and a rank, against
    # those that leave 2 by two letters and a rank
    before = np.zeros(len(sorted_sample), np.int64)
    is_one = sorted_sample % 3 == 1
    for mask, letters in ((is_one, 1), (~is_one, 2)):
        own = sorted_sample[mask]
        both = np.concatenate([rest, own])
        columns = [t[both + k] for k in range(letters)] + [rank[both + letters]]
        name = _ranked(*columns)
        before[mask] = np.searchsorted(name[: len(rest)], name[len(rest) :], side="left")
    merged = np.empty(n, np.int64)
    place = np.arange(len(sorted_sample)) + before
    merged[place] = sorted_sample
    free = np.ones(n, bool)
    free[place] = False
    merged[free] = rest
    return merged


def equal_prefixes(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For suffix starts in suffix order: whether each shares its first ``width`` bytes with the one before."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(len(data), np.uint64)
    for k in range(8):
        words |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    same = np.ones(len(starts), bool)
    if len(starts):
        same[0] = False
    for at in [*range(0, width - 7, 8), width - 8]:
        w = words[starts + at]
        same[1:] &= w[1:] == w[:-1]
    return same
