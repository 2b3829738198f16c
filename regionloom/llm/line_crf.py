"""Quality of documents from a linear-chain conditional random field over their lines.

Every line is good or bad. What speaks for either are measures of the line (shares of letters, capitals, symbols, repeated
words and so on) and of the lines before and after it; a transition score ties neighbours together. Forward-backward gives
each line the probability to be good; the mean over the lines, weighted by their lengths, is the quality of the document.

The field is fitted on a bounded sample of labelled documents whose lines all carry the document's label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from regionloom.llm.labelled import labelled_sample
from regionloom.llm.text import Rolling, Texts, by_slices, later, sums, within

SAMPLE_ROWS = 3000
SAMPLE_LINES = 2000
THRESHOLD = 0.7


def _marks(characters: str) -> np.ndarray:
    marks = np.zeros(256, bool)
    marks[list(characters.encode())] = True
    return marks


_LOWER = _marks("abcdefghijklmnopqrstuvwxyz")
_UPPER = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _marks("0123456789")
_SYMBOL = _marks("#*$%&|<>@^~=+_{}[]\\")
_LOUD = _marks("!?")
_POINT = _marks(".,;:'\"()-/")
_WIDE = np.arange(256) >= 128
_BLANK = _marks(" \t")
CLASSES = (_LOWER, _UPPER, _DIGIT, _SYMBOL, _LOUD, _POINT, _WIDE, _BLANK)
N_OWN = len(CLASSES) + 8


def line_measures(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of measures, the length in bytes and the document of each line."""
    starts, ends, rows = texts.lines()
    length = ends - starts
    n = len(starts)
    columns = []
    for marks in CLASSES:
        upto = np.concatenate([[0], np.cumsum(marks[texts.data])])
        columns.append(np.sqrt((upto[ends] - upto[starts]) / np.maximum(length, 1)))
    rolling = Rolling(texts.data)
    word_starts, word_ends = texts.words()
    line_of = np.searchsorted(starts, word_starts, side="right") - 1
    words = np.bincount(line_of, minlength=n)
    some = np.maximum(words, 1)
    hashes = rolling.of(word_starts, word_ends)
    small = np.concatenate([[0], np.cumsum(_LOWER[texts.data] | _WIDE[texts.data])])
    without_small = small[word_ends] == small[word_starts]
    columns += [
        np.log1p(length) / 8,
        np.log1p(words) / 6,
        (sums(word_ends - word_starts, line_of, n) / some) / 10,
        sums(later(within(hashes, line_of)), line_of, n) / some,
        sums(without_small, line_of, n) / some,
        sums((word_ends - word_starts) == 1, line_of, n) / some,
        later(within(rolling.of(starts, ends), rows)).astype(float),
        (words == 0).astype(float),
    ]
    return np.column_stack(columns), length, rows


def with_neighbours(own: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Measures of each line, of the ones before and after it (zeros where there is none), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = rows[1:] == rows[:-1]
    before[1:][joined] = own[:-1][joined]
    after[:-1][joined] = own[1:][joined]
    ends = np.ones((len(own), 2))
    ends[1:, 0] = ~joined
    ends[:-1, 1] = ~joined
    return np.hstack([own, before, after, ends, np.ones((len(own), 1))])


class Chains:
    """Lines of several documents, walked side by side."""

    def __init__(self, rows: np.ndarray):
        cuts = np.flatnonzero(np.diff(rows)) + 1
        self.first = np.concatenate([[0], cuts]) if len(rows) else np.zeros(0, np.int64)
        self.length = np.diff(np.append(self.first, len(rows)))
        order = np.argsort(-self.length, kind="stable")
        self.first_sorted, length = self.first[order], self.length[order]
        longest = int(length[0]) if len(length) else 0
        self.active = np.searchsorted(-length, -np.arange(longest), side="left")

    def at(self, t: int) -> np.ndarray:
        return self.first_sorted[: self.active[t]] + t

    def marginals(self, good: np.ndarray, moves: np.ndarray):
        """Log odds of a good line by itself -> probability of good, expected moves (4), log of the sum over labellings."""
        n, longest = len(good), len(self.active)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        own = np.column_stack([np.zeros(n), good])
        for t in range(longest):
            at = self.at(t)
            forward[at] = own[at]
            if t:
                before = forward[at - 1]
                forward[at] += np.logaddexp(before[:, :1] + moves[0], before[:, 1:] + moves[1])
        for t in range(longest - 2, -1, -1):
            at = self.at(t + 1)
            after = backward[at] + own[at]
            backward[at - 1] = np.logaddexp(after[:, :1] + moves[:, 0], after[:, 1:] + moves[:, 1])
        both = forward + backward
        total = np.logaddexp(both[:, 0], both[:, 1])
        inner = np.ones(n, bool)
        inner[self.first] = False
        at = np.flatnonzero(inner)
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                expected[a, b] = np.exp(forward[at - 1, a] + moves[a, b] + own[at, b] + backward[at, b] - total[at]).sum()
        return np.exp(both[:, 1] - total), expected, total[self.first]


def fit_field(measures: np.ndarray, rows: np.ndarray, labels: np.ndarray, steps: int = 200, decay: float = 3e-4) -> dict:
    """Weights of the measures and of the moves, by gradient steps (Adam) on the likelihood. ``labels`` are of lines."""
    inputs = with_neighbours(measures, rows)
    chains = Chains(rows)
    n_docs, d = max(1, len(chains.first)), inputs.shape[1]
    seen = np.zeros((2, 2))
    joined = rows[1:] == rows[:-1]
    np.add.at(seen, (labels[:-1][joined].astype(int), labels[1:][joined].astype(int)), 1)
    weights, mean, spread = np.zeros(d + 4), np.zeros(d + 4), np.zeros(d + 4)
    for step in range(1, steps + 1):
        good, expected, _ = chains.marginals(inputs @ weights[:d], weights[d:].reshape(2, 2))
        slope = np.concatenate([inputs.T @ (good - labels), (expected - seen).ravel()]) / n_docs + decay * weights
        mean += 0.1 * (slope - mean)
        spread += 0.01 * (slope * slope - spread)
        weights -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-9)
    return {"weights": weights[:d], "moves": weights[d:].reshape(2, 2)}


def document_scores(texts: Texts, field: dict) -> np.ndarray:
    own, length, rows = line_measures(texts)
    good, _, _ = Chains(rows).marginals(with_neighbours(own, rows) @ field["weights"], field["moves"])
    weight = length + 1.0
    return np.bincount(rows, good * weight, minlength=texts.n) / np.bincount(rows, weight, minlength=texts.n)


def fitted_on(sample: DataFrame, sample_lines: int) -> dict:
    """Fit on the sample (``__id``, ``__text``, ``__label``); texts of more lines than ``sample_lines`` are left out of it."""

    def measured(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        own, _, rows = line_measures(texts)
        cuts = np.searchsorted(rows, np.arange(texts.n + 1))
        blobs = [own[a:b].astype(np.float32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(blobs, pa.binary())], names=["__id", "__label", "__own"])

    short = sample.where(F.regexp_count("__text", F.lit("\n")) < sample_lines)
    kind = dict(sample.dtypes)["__id"]
    found: pd.DataFrame = by_slices(short, "__text", measured, f"__id {kind}, __label int, __own binary").toPandas()
    found = found.sort_values("__id", ignore_index=True)
    labels = found["__label"].to_numpy(float)
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 1.0
        weights = np.zeros(3 * N_OWN + 3)
        weights[-1] = np.clip(np.log((share + 0.01) / (1.01 - share)), -5, 5)
        return {"weights": weights, "moves": np.zeros((2, 2))}
    own = [np.frombuffer(x, np.float32).reshape(-1, N_OWN).astype(float) for x in found["__own"]]
    rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
    return fit_field(np.vstack(own), rows, labels[rows])


def line_field_quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    learn_where: Column | None = None,
    threshold: float = THRESHOLD,
    sample_rows: int = SAMPLE_ROWS,
    sample_lines: int = SAMPLE_LINES,
) -> DataFrame:
    """Id, ``score`` (0 to 1, higher: label 1 is likelier) and ``predicted`` (1 from ``threshold`` on) of every document.

    ``learn_where`` restricts the labelled rows that may be learned from (a condition on ``__id``). The sample has
    ``sample_rows`` documents of at most ``sample_lines`` lines; the measures of its lines come to the driver.
    A NULL or empty text is one empty line. Rows with equal ids are scored each on its own. Without labels, or with one
    label only, every text gets the share of label 1. Columns other than the id and the text are never read.
    """
    field = fitted_on(labelled_sample(docs, labels, label, sample_rows, doc_id, text, learn_where), sample_lines)

    def score(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        scores = document_scores(texts, field)
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["id", "score", "predicted"]
        )

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    scored = by_slices(rows, "text", score, f"id {dict(rows.dtypes)['id']}, score double, predicted int")
    return scored.withColumnRenamed("id", doc_id)


def good_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the field predicts to be good; columns as before. The rows are judged where they stand."""
    options = {"threshold": THRESHOLD} | options
    sample = labelled_sample(docs, labels, options.get("label", "quality"), options.get("sample_rows", SAMPLE_ROWS), doc_id, text)
    field = fitted_on(sample, options.get("sample_lines", SAMPLE_LINES))
    place = docs.columns.index(text)

    def keep(batches):
        from regionloom.llm.text import slices

        for batch in batches:
            for part in slices(batch, batch.schema.names[place]):
                good = document_scores(Texts(part.column(place)), field) >= options["threshold"]
                yield part.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
