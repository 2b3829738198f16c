"""Quality rules: counts against fixed thresholds, and a calibrated logistic regression over hashed n-grams.

Word n-grams (one and two words) and character n-grams (three and five bytes of UTF-8) are hashed into a fixed number of
weights. A text's logit is the mean weight of its word n-grams plus that of its character n-grams plus a constant. The
regression is fitted on a bounded sample of labelled rows, one third of which is kept apart to calibrate the
probabilities (Platt's scaling). All texts are scored whole, in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regionloom.llm.labelled import labelled_sample
from regionloom.llm.text import Rolling, Texts, by_slices, later, repeated, runs, sums, within

BITS = 17
SAMPLE_ROWS = 2000
THRESHOLD = 0.3

# fixed values: the rules of the base
LEAST_WORDS, REPEAT_WORDS, MOST_REPEATED_PERCENT, SYMBOLS = 10, 5, 20, "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


class Rules:
    """The counts of the base for some texts."""

    def __init__(self, texts: Texts):
        n, data = texts.n, texts.data
        row_of = np.repeat(np.arange(n), np.diff(texts.bounds))
        rolling = Rolling(data)
        starts, ends = texts.words()
        self.rows = texts.owner(starts)
        self.hashes = rolling.of(starts, ends)
        self.rolling, self.row_of = rolling, row_of
        self.n_words = np.bincount(self.rows, minlength=n)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1
        np.subtract.at(inside, ends, 1)
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        self.word_chars = sums(inside & ((data & 0xC0) != 0x80), row_of, n)
        self.n_symbols = sums(_SYMBOL[data], row_of, n)
        line_starts, line_ends, line_rows = texts.lines()
        upto = np.concatenate([[0], np.cumsum(inside)])
        filled = upto[line_ends] > upto[line_starts]
        keys = within(rolling.of(line_starts[filled], line_ends[filled]), line_rows[filled])
        self.n_dup_lines = sums(later(keys), line_rows[filled], n)
        windows, at = runs(self.hashes, self.rows, REPEAT_WORDS)
        twice = at[repeated(within(windows, self.rows[at]))]
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.subtract.at(cover, twice + REPEAT_WORDS, 1)
        self.n_repeat_words = sums(np.cumsum(cover)[:-1] > 0, self.rows, n)
        self.failed = (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED_PERCENT * self.n_words)


def ngrams(rules: Rules, bits: int):
    """Pairs (hashed n-grams, their rows), first those of words, then those of characters."""
    shift = np.uint64(64 - bits)
    words = [(rules.hashes >> shift, rules.rows)]
    pairs, at = runs(rules.hashes, rules.rows, 2)
    words.append((pairs >> shift, rules.rows[at]))
    characters = []
    for width in (3, 5):
        hashes = rules.rolling.fixed(width)
        m = len(hashes)
        whole = rules.row_of[:m] == rules.row_of[width - 1 : width - 1 + m]
        characters.append((hashes[whole] >> shift, rules.row_of[:m][whole]))
    return words, characters


def logits(rules: Rules, n: int, weights: np.ndarray, bits: int) -> np.ndarray:
    total = np.full(n, weights[-1])
    for family in ngrams(rules, bits):
        sum_, count = np.zeros(n), np.zeros(n)
        for hashed, rows in family:
            sum_ += np.bincount(rows, weights[hashed.astype(np.int64)], minlength=n)
            count += np.bincount(rows, minlength=n)
        total += sum_ / np.maximum(count, 1)
    return total


def _sparse(bits: int):
    def features(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        rules = Rules(texts)
        where, what = [[] for _ in range(texts.n)], [[] for _ in range(texts.n)]
        for family in ngrams(rules, bits):
            rows = np.concatenate([r for _, r in family])
            keys, counts = np.unique(rows * (1 << bits) + np.concatenate([h for h, _ in family]).astype(np.int64), return_counts=True)
            share = counts / np.maximum(np.bincount(rows, minlength=texts.n), 1)[keys >> bits]
            cuts = np.searchsorted(keys >> bits, np.arange(texts.n + 1))
            for i in range(texts.n):
                where[i].append((keys[cuts[i] : cuts[i + 1]] & ((1 << bits) - 1)).astype(np.int32))
                what[i].append(share[cuts[i] : cuts[i + 1]].astype(np.float32))
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                part.column(2).cast(pa.int32()),
                pa.array([np.concatenate(x).tobytes() for x in where], pa.binary()),
                pa.array([np.concatenate(x).tobytes() for x in what], pa.binary()),
            ],
            names=["__id", "__label", "__where", "__what"],
        )

    return features


def _fit(rows: np.ndarray, where: np.ndarray, what: np.ndarray, labels: np.ndarray, size: int, steps: int, decay: float) -> np.ndarray:
    """Logistic regression by Adam over all rows; both labels weigh the same."""
    n = len(labels)
    balance = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, n - labels.sum()))
    weights, mean, spread = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights[where] * what, minlength=n) + weights[-1]
        error = (1 / (1 + np.exp(-z)) - labels) * balance
        slope = np.append(np.bincount(where, error[rows] * what, minlength=size), error.sum()) + decay * weights
        mean += 0.1 * (slope - mean)
        spread += 0.01 * (slope * slope - spread)
        weights -= 0.5 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-9)
    return weights


def _platt(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of calibrated logits, by Newton's steps on Platt's smoothed labels."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    wanted = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        v = p * (1 - p) + 1e-9
        gradient = np.array([((p - wanted) * z).sum() + 1e-3 * (slope - 1), (p - wanted).sum()])
        second = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        move = np.linalg.solve(second, gradient)
        slope, offset = slope - np.clip(move[0], -1, 1), offset - np.clip(move[1], -2, 2)
    return float(slope), float(offset)


def fit_rules(sample: pd.DataFrame, bits: int = BITS, steps: int = 120, decay: float = 1e-6) -> dict:
    """Weights and calibration from the hashed features of the sample. With one label only, everything gets its share."""
    labels = sample["__label"].to_numpy(float)
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 1.0
        offset = float(np.clip(np.log((share + 0.01) / (1.01 - share)), -5, 5))
        return {"weights": np.zeros((1 << bits) + 1), "slope": 0.0, "offset": offset, "bits": bits}
    where = [np.frombuffer(x, np.int32) for x in sample["__where"]]
    what = [np.frombuffer(x, np.float32) for x in sample["__what"]]

    def flat(chosen):
        rows = np.repeat(np.arange(len(chosen)), [len(where[i]) for i in chosen])
        return rows, np.concatenate([where[i] for i in chosen]), np.concatenate([what[i] for i in chosen]).astype(float)

    apart = np.arange(len(labels)) % 3 == 2
    if len(set(labels[~apart])) < 2 or len(set(labels[apart])) < 2:
        apart[:] = False
    train = np.flatnonzero(~apart)
    weights = _fit(*flat(train), labels[train], 1 << bits, steps, decay)
    test = np.flatnonzero(apart) if apart.any() else train
    rows, at, values = flat(test)
    slope, offset = _platt(np.bincount(rows, weights[at] * values, minlength=len(test)) + weights[-1], labels[test])
    return {"weights": weights, "slope": slope, "offset": offset, "bits": bits}


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    threshold: float = THRESHOLD,
    sample_rows: int = SAMPLE_ROWS,
    bits: int = BITS,
) -> DataFrame:
    """Counts, verdict of the base and verdict of the model for every document.

    ``sample_rows`` bounds the labelled rows that the model is fitted on (smallest hashes of ids); their hashed features
    come to the driver, at most 2^bits numbers each. A text passes if the base passes it and its calibrated probability of
    label 1 is ``threshold`` at least. NULL and empty texts have no words, so the base fails them; rows with equal ids are
    judged each on its own; without labels every text has a probability above the threshold; other columns are not read.
    """
    sample = labelled_sample(docs, labels, label, sample_rows, doc_id, text).select("__id", "__text", "__label")
    found = by_slices(sample, "__text", _sparse(bits), f"__id {dict(sample.dtypes)['__id']}, __label int, __where binary, __what binary")
    model = fit_rules(found.toPandas().sort_values("__id", ignore_index=True), bits)

    def score(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        rules = Rules(texts)
        z = logits(rules, texts.n, model["weights"], model["bits"])
        probability = 1 / (1 + np.exp(-np.clip(model["slope"] * z + model["offset"], -30, 30)))
        counts = [rules.n_words, rules.word_chars, rules.n_symbols, rules.n_dup_lines, rules.n_repeat_words]
        return pa.RecordBatch.from_arrays(
            [part.column(0)]
            + [pa.array(x, pa.int64()) for x in counts]
            + [pa.array(rules.failed), pa.array(~rules.failed & (probability >= threshold)), pa.array(probability)],
            names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"],
        )

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return by_slices(rows, "text", score, f"{schema}, base_failed boolean, kept boolean, probability double").withColumnRenamed("id", doc_id)
