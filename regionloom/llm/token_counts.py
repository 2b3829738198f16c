"""Exact counts of all tokens of a corpus, and sums over each document's tokens, without a row a token.

A task packs the distinct words of some documents, dealt to buckets by their hashes, with the documents they stand in. A
bucket then knows how often each of its words is in the whole corpus and adds up what each document needs. Only these
packed rows travel: about eight bytes a distinct word and three bytes a distinct word of a document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from regionloom.llm.text import Rolling, Texts, slices
from regionloom.session import stage

BUCKET_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers in the fewest bytes each that hold the largest."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.dtype(f"u{blob[0]}"), offset=1).astype(np.int64)


def token_rows(docs: DataFrame, doc_id: str, text: str, learn: Column) -> DataFrame:
    """``id``, ``text`` (never NULL), ``digest`` (a hash of it) and ``learn`` (counted as training)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("id"), whole.alias("text"), F.xxhash64(whole).alias("digest"), learn.alias("learn"))


def _letters(texts: Texts, starts: np.ndarray, ends: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """How often each byte is in the words of the texts to learn from; the space ends a word."""
    own = np.repeat(learn, np.diff(texts.bounds))
    total = np.bincount(texts.data[own], minlength=256)
    total[[9, 10, 11, 12, 13]] = 0
    total[32] = learn[texts.owner(starts)].sum()
    return total


def _packer(buckets: int):
    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                yield pack(part, Texts(part.column(1)).lowered(), chunk)
                chunk += 1
            pa.default_memory_pool().release_unused()

    def pack(part: pa.RecordBatch, texts: Texts, chunk: int) -> pa.RecordBatch:
        starts, ends = texts.words()
        rows = texts.owner(starts)
        words, which = np.unique(Rolling(texts.data).of(starts, ends), return_inverse=True)
        pairs, counts = np.unique(which * texts.n + rows, return_counts=True)
        word_of, doc_of = pairs // max(1, texts.n), pairs % max(1, texts.n)
        bucket = (words >> np.uint64(40)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        pair_order = np.argsort(bucket[word_of], kind="stable")
        pair_cuts = np.searchsorted(bucket[word_of][pair_order], np.arange(buckets + 1))
        degree = np.bincount(word_of, minlength=len(words))
        learn = np.array(part.column(3).to_pylist(), bool)
        used = np.flatnonzero(np.diff(cuts))
        made = {
            "bucket": [-1, *used.tolist()],
            "words": [b""] + [words[order[cuts[b] : cuts[b + 1]]].tobytes() for b in used],
            "degrees": [packed(np.bincount(rows, minlength=texts.n))] + [packed(degree[order[cuts[b] : cuts[b + 1]]]) for b in used],
            "docs": [packed(_letters(texts, starts, ends, learn))] + [packed(doc_of[pair_order[pair_cuts[b] : pair_cuts[b + 1]]]) for b in used],
            "counts": [b""] + [packed(counts[pair_order[pair_cuts[b] : pair_cuts[b + 1]]]) for b in used],
        }
        n = len(made["bucket"])
        nulls = [None] * (n - 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(made["bucket"], pa.int32()),
                pa.array([chunk] * n, pa.int64()),
                pa.array([packed(learn)] * n, pa.binary()),
                *[pa.array(made[c], pa.binary()) for c in ("words", "degrees", "docs", "counts")],
                pa.array([part.column(0).to_pylist(), *nulls], pa.list_(part.schema.field(0).type)),
                pa.array([part.column(2).to_pylist(), *nulls], pa.list_(pa.int64())),
            ],
            names=["bucket", "chunk", "learn", "words", "degrees", "docs", "counts", "ids", "digests"],
        )

    return run


def _summed(smoothing: float, frequent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        words = [np.frombuffer(x, np.uint64) for x in group["words"]]
        degrees = [unpacked(x) for x in group["degrees"]]
        documents = [unpacked(x) for x in group["docs"]]
        counts = [unpacked(x) for x in group["counts"]]
        learn = [unpacked(x) > 0 for x in group["learn"]]
        local = [np.repeat(np.arange(len(d)), d) for d in degrees]
        trained = [np.bincount(at, c * t[d], minlength=len(w)) for at, c, t, d, w in zip(local, counts, learn, documents, words, strict=True)]
        distinct, where = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(where, np.concatenate(trained), minlength=len(distinct))
        cuts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        score = np.log10(total + smoothing)
        sums, known = [], []
        for k in range(len(words)):
            own = where[cuts[k] : cuts[k + 1]][local[k]]
            n = len(learn[k])
            sums.append(np.bincount(documents[k], counts[k] * score[own], minlength=n).tobytes())
            known.append(packed(np.bincount(documents[k], counts[k] * (total[own] > 0), minlength=n).astype(np.int64)))
        first = np.arange(len(words)) == 0
        top = np.argsort(-total, kind="stable")[:frequent]
        top = top[total[top] > 0]
        return pd.DataFrame(
            {
                "chunk": group["chunk"],
                "bucket": group["bucket"],
                "sums": sums,
                "known": known,
                "n": np.where(first, int(total.sum()), 0),
                "v": np.where(first, int((total > 0).sum()), 0),
                "top": [distinct[top].tobytes() if f else b"" for f in first],
                "often": [total[top].astype(np.int64).tobytes() if f else b"" for f in first],
            }
        )

    return run


class TokenCounts:
    """Counts of the tokens of ``rows`` (see :func:`token_rows`).

    Tokens are the words with A-Z in lower case and one end a text. ``n`` is the number of tokens in texts to learn from, ``v``
    of distinct ones, ``ends`` of such texts. ``frequent`` bounds the vocabulary.
    """

    def __init__(self, rows: DataFrame, smoothing: float = 0.1, frequent: int = 1 << 16):
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(8, -(-size // BUCKET_BYTES))
        self.kind, self.smoothing, self.frequent = dict(rows.dtypes)["id"], smoothing, frequent
        schema = "bucket int, chunk long, learn binary, words binary, degrees binary, docs binary, counts binary"
        self.every = stage(rows.mapInArrow(_packer(buckets), f"{schema}, ids array<{self.kind}>, digests array<bigint>"))
        partial = self.every.where("bucket >= 0").drop("ids", "digests").groupBy("bucket")
        schema = "chunk long, bucket int, sums binary, known binary, n long, v long, top binary, often binary"
        self.partial = stage(partial.applyInPandas(_summed(smoothing, frequent), schema))
        self.ends = rows.where("learn").count()
        n, v = self.partial.agg(F.sum("n"), F.sum("v")).first()
        self.n, self.v = (n or 0) + self.ends, (v or 0) + (self.ends > 0)

    def letters(self) -> np.ndarray:
        """How often each byte is in the words to learn from."""

        def add(batches):
            total = np.zeros(256, np.int64)
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    total += unpacked(blob)
            yield pa.RecordBatch.from_arrays([pa.array(range(256)), pa.array(total)], names=["byte", "n"])

        found = self.every.where("bucket < 0").select("docs").mapInArrow(add, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n"))
        total = np.zeros(256)
        for byte, n in found.collect():
            total[byte] = n
        return total

    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (ascending) and counts of all words that are more frequent than a limit, which ``frequent`` of them pass at most.

        The limit comes from a histogram of counts, in steps of an eighth of a power of two. Words seen once never pass:
        how many they are tells how often a word that was never seen comes.
        """
        blobs = self.partial.where("length(top) > 0").select("top", "often")

        def steps(often: np.ndarray) -> np.ndarray:
            return np.floor(np.log2(often) * 8).astype(np.int64)

        def histogram(batches):
            for batch in batches:
                for often in batch.column(1).to_pylist():
                    step, n = np.unique(steps(np.frombuffer(often, np.int64)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n)], names=["step", "n"])

        found = blobs.mapInArrow(histogram, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
        limit, total = 1 << 30, 0
        for step, n in sorted(found, reverse=True):
            total += n
            if total > self.frequent or step < 8:
                break
            limit = step

        def chosen(batches):
            for batch in batches:
                for top, often in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    often = np.frombuffer(often, np.int64)
                    keep = steps(often) >= limit
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.frombuffer(top, np.uint64)[keep].view(np.int64)), pa.array(often[keep])], names=["word", "n"]
                    )

        words = blobs.mapInArrow(chosen, "word long, n long").toPandas()
        hashes = words["word"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        return hashes[order], words["n"].to_numpy(np.int64)[order]

    def scores(self) -> DataFrame:
        """For each row: ``id``, ``digest``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``.

        The score is the sum over the tokens of the decimal log of (c + s) / (N + s (V + 1)) with the token's count c.
        """
        n, ends = self.n, self.ends
        norm, end = float(np.log10(max(n + self.smoothing * (self.v + 1), 1e-300))), float(np.log10(ends + self.smoothing))

        def documents(group: pd.DataFrame) -> pd.DataFrame:
            head = group[group["bucket"] < 0].iloc[0]
            rest = group[group["bucket"] >= 0].sort_values("bucket")
            n_tokens = unpacked(head["degrees"]) + 1
            total, known = np.full(len(n_tokens), end), np.full(len(n_tokens), int(ends > 0))
            for a, b in zip(rest["sums"], rest["known"], strict=True):
                total, known = total + np.frombuffer(a, float), known + unpacked(b)
            made = {"id": list(head["ids"]), "digest": head["digests"], "n_tokens": n_tokens, "n_known": known}
            return pd.DataFrame(made | {"train_tokens": n, "base_score": total - n_tokens * norm})

        heads = self.every.where("bucket < 0").select("chunk", "bucket", "degrees", "ids", "digests")
        joined = heads.unionByName(self.partial.select("chunk", "bucket", "sums", "known"), allowMissingColumns=True)
        schema = f"id {self.kind}, digest long, n_tokens long, n_known long, train_tokens long, base_score double"
        return joined.groupBy("chunk").applyInPandas(documents, schema)
