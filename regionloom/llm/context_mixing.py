"""Language-model scores by logistic context mixing.

A text is coded as its tokens, words with A-Z in lower case and one end, by binary decisions. A token of the vocabulary (the
frequent words of the corpus) is a path in a code tree over the vocabulary; any other one is the path of an escape and
then a path in a code tree over bytes for each of its bytes and for the space that ends it. Both trees are Huffman's.

Several predictors give a log odds for each decision. On word paths: the counts of the vocabulary itself, and two tables
addressed by a hash of the tree's node with the word before, and with the two words before. On byte paths: three tables
addressed by a hash of the node with the last two, three and five bytes of the word. All tables hold counts over all texts to
learn from. The predictors are mixed by weights that are gated by the kind of the decision. The weights learn from each
block of a text for the next ones (blocks grow from 32 to 2,048 tokens), and so does a table that refines the mixed
probability. The sum of the logs over all decisions is the score.

What is the same for all occurrences of a word in a slice of the corpus is worked out once for it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from regionloom.llm.text import Rolling, Texts, by_slices, slices
from regionloom.llm.token_counts import TokenCounts, token_rows
from regionloom.session import stage

#: Words that the vocabulary holds at most.
VOCABULARY = 1 << 16
#: Bits of the addresses of the tables: last two, three, five bytes; one word, two words before.
TABLE_BITS = (18, 20, 20, 22, 22)
CONTEXT_BYTES = (2, 3, 5)
SEGMENT = 1 << 12
#: By gate (word path, first three bytes of a word, later bytes): the weights of the predictors at the start of a text.
START_WEIGHTS = ((0.85, 0.15, 0.25), (0.2, 0.4, 0.55), (0.2, 0.4, 0.55))
GATES = len(START_WEIGHTS)
SLICE = 1 << 19
#: Tokens that are handled at once.
PIECE = 1 << 12
RATE = 1.5
REFINED = 33

SPACE = 32
_U = np.uint32


def code_tree(counts: np.ndarray) -> dict:
    """Huffman's code of the symbols 0, 1, ...: the path of symbol s is the entries ``first[s]`` ... of ``node`` (numbers of
    inner nodes), ``bit`` (the way taken) and ``odds`` (log odds of the way 1 by the counts), ``length[s]`` of them."""
    n = len(counts)
    weight = np.zeros(2 * n - 1)
    weight[:n] = counts
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    heap = [(float(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    for node in range(n, 2 * n - 1):
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        weight[node] = a + b
        parent[left] = parent[right] = node
        side[right] = 1
        heapq.heappush(heap, (a + b, node))
    root = 2 * n - 2
    length = np.zeros(n, np.int64)
    at = np.arange(n)
    while (moving := at != root).any():
        length += moving
        at = np.where(moving, parent[at], at)
    first = np.cumsum(length) - length
    node, bit = np.zeros(length.sum(), _U), np.zeros(length.sum(), np.uint8)
    odds = np.zeros(length.sum())
    at, left = np.arange(n), length.copy()
    while (left > 0).any():
        moving = np.flatnonzero(left > 0)
        left[moving] -= 1
        place, child = first[moving] + left[moving], at[moving]
        up = parent[child]
        node[place], bit[place] = (up - n).astype(_U), side[child]
        share = weight[child] / weight[up]
        odds[place] = np.where(side[child] == 1, 1.0, -1.0) * np.log(share / np.maximum(1 - share, 1e-12))
        at[moving] = up
    return {"length": length, "first": first, "node": node, "bit": bit, "odds": np.clip(np.rint(odds * 16), -127, 127).astype(np.int8)}


def coding(counts: TokenCounts) -> dict:
    """Vocabulary and trees. The symbols after the words are the end of a text and the escape."""
    hashes, often = counts.vocabulary()
    rest = counts.n - counts.ends - int(often.sum())
    letters = counts.letters()
    return {
        "hashes": hashes,
        "words": code_tree(np.concatenate([often, [counts.ends + 1, rest + 1]])),
        "letters": code_tree(letters + letters.sum() / 4096 + 1),
    }


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    h = h * _U(0x2C1B3C6D)
    h ^= h >> _U(15)
    h *= _U(0x297A2D39)
    return h >> _U(32 - bits)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[0], first[0] + 1, ... (count[0] of them), then those from first[1] on, and so on."""
    upto = np.cumsum(count)
    return np.arange(upto[-1] if len(count) else 0) + np.repeat(first - (upto - count), count)


class Words:
    """The tokens of some texts, and the decisions of each distinct one."""

    def __init__(self, texts: Texts, code: dict):
        lowered = texts.lowered()
        starts, ends = lowered.words()
        rows = lowered.owner(starts)
        hashes, sample, which = np.unique(Rolling(lowered.data).of(starts, ends), return_index=True, return_inverse=True)
        n_words, vocabulary = len(hashes), code["hashes"]
        # tokens in the order of the texts; the last distinct "word" is the end
        self.n_tokens = np.bincount(rows, minlength=texts.n) + 1
        self.n_bytes = 1 + np.bincount(rows, ends - starts + 1, minlength=texts.n)
        offset = np.concatenate([[0], np.cumsum(self.n_tokens)])
        self.token = np.full(offset[-1], n_words)
        self.token[np.arange(len(rows)) + rows] = which
        self.rows = np.repeat(np.arange(texts.n), self.n_tokens)
        self.index = np.arange(offset[-1]) - offset[:-1][self.rows]
        short = np.append((hashes >> np.uint64(32)).astype(_U), _U(1))[self.token]
        one = np.where(self.index > 0, np.concatenate([[_U(0)], short[:-1]]), _U(0))
        two = np.where(self.index > 1, np.concatenate([np.zeros(2, _U), short[:-2]])[: len(short)], _U(0))
        self.before = (one * _U(0x9E3779B1), one * _U(0x9E3779B1) + two * _U(0x85EBCA77) + _U(1))
        # symbols of the distinct words, and the bytes of those that are not in the vocabulary
        place = np.searchsorted(vocabulary, hashes)
        known = np.zeros(n_words, bool)
        if len(vocabulary):
            place = np.minimum(place, len(vocabulary) - 1)
            known = vocabulary[place] == hashes
        symbol = np.append(np.where(known, place, len(vocabulary) + 1), len(vocabulary))
        spelled = np.flatnonzero(~known)
        length = ends[sample[spelled]] - starts[sample[spelled]] + 1
        begin = np.cumsum(length) - length
        data = np.full(int(length.sum()), SPACE, np.uint8)
        within = _ranges(np.zeros(len(length), np.int64), length)
        inner = within < np.repeat(length - 1, length)
        data[inner] = lowered.data[(np.repeat(starts[sample[spelled]], length) + within)[inner]]
        letters, paths = code["letters"], code["words"]
        byte_steps = letters["length"][data]
        spelled_steps = np.add.reduceat(byte_steps, begin) if len(begin) else np.zeros(0, np.int64)
        head = paths["length"][symbol]
        tail = np.zeros(n_words + 1, np.int64)
        tail[spelled] = spelled_steps
        self.n_steps = head + tail
        self.first_step = np.cumsum(self.n_steps) - self.n_steps
        total = int(self.n_steps.sum())
        self.bit = np.zeros(total, np.uint8)
        self.node = np.zeros(total, _U)
        self.static = np.zeros((total, 3), np.int8)
        to, source = _ranges(self.first_step, head), _ranges(paths["first"][symbol], head)
        self.node[to] = paths["node"][source] * _U(0x27D4EB2F) + _U(0x165667B1)
        self.bit[to], self.static[to, 0] = paths["bit"][source], paths["odds"][source]
        self.spelled = _ranges((self.first_step + head)[spelled], spelled_steps)
        source = _ranges(letters["first"][data], byte_steps)
        byte_of = np.repeat(np.arange(len(data)), byte_steps)
        self.bit[self.spelled] = letters["bit"][source]
        of_gate = np.zeros((n_words + 1, GATES), np.int64)
        of_gate[:, 0] = head
        if len(begin):
            early = np.add.reduceat(np.where(within < 3, byte_steps, 0), begin)
            of_gate[spelled, 1], of_gate[spelled, 2] = early, spelled_steps - early
        self.gate_steps = of_gate
        rolling, now = Rolling(data), np.arange(len(data))
        self.slots = []
        for k, width in enumerate(CONTEXT_BYTES):
            context = rolling.of(np.maximum(now - width, now - within), now)
            h = (context >> np.uint64(32)).astype(_U)[byte_of] + letters["node"][source] * _U(0x9E3779B1) + _U(k)
            self.slots.append(_slot(h, TABLE_BITS[k]))

    def paired_slots(self, k: int, node: np.ndarray, n: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return _slot(node + np.repeat(self.before[k][tokens], n), TABLE_BITS[3 + k])


def _counting(code: dict):
    starts = np.concatenate([[0], np.cumsum([1 << (b + 1) for b in TABLE_BITS])])

    def run(batches):
        counts = np.zeros(starts[-1], np.uint32)
        for batch in batches:
            batch = batch.filter(batch.column(1))
            for part in slices(batch, "text", SLICE):
                words = Words(Texts(part.column(0)), code.value)
                often = np.repeat(np.bincount(words.token, minlength=len(words.n_steps)).astype(_U), words.n_steps)[words.spelled]
                bit = words.bit[words.spelled].astype(_U)
                for k in range(3):
                    np.add.at(counts[starts[k] : starts[k + 1]], words.slots[k] * _U(2) + bit, often)
                for a in range(0, len(words.token), PIECE):
                    tokens = np.arange(a, min(a + PIECE, len(words.token)))
                    word = words.token[tokens]
                    n = words.gate_steps[word, 0]
                    steps = _ranges(words.first_step[word], n)
                    node, bit = words.node[steps], words.bit[steps].astype(_U)
                    for k in range(2):
                        np.add.at(counts[starts[3 + k] : starts[4 + k]], words.paired_slots(k, node, n, tokens) * _U(2) + bit, _U(1))
        for s in range(0, len(counts), SEGMENT):
            piece = counts[s : s + SEGMENT]
            if piece.any():
                over = np.flatnonzero(piece > 255)
                low = np.minimum(piece, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s // SEGMENT], pa.int32()),
                        pa.array([low.tobytes()], pa.binary()),
                        pa.array([over.astype(np.uint16).tobytes()], pa.binary()),
                        pa.array([(piece[over] - 255).tobytes()], pa.binary()),
                    ],
                    names=["segment", "low", "over", "more"],
                )

    return run


def _adding(batches):
    """Counts of the segments that a task gets, added up; then as log odds, eight bits each."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, low, over, more in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            added = total.setdefault(segment, np.zeros(SEGMENT, np.int64))
            added += np.frombuffer(low, np.uint8)
            added[np.frombuffer(over, np.uint16)] += np.frombuffer(more, np.uint32)
    for segment, added in total.items():
        odds = np.log((added[1::2] + 0.4) / (added[::2] + 0.4))
        small = np.clip(np.rint(odds * 16), -127, 127).astype(np.int8)
        yield pa.RecordBatch.from_arrays(
            [pa.array([segment], pa.int32()), pa.array([small.tobytes()], pa.binary())], names=["segment", "odds"]
        )


def learned_tables(rows: DataFrame, code: dict) -> list[np.ndarray]:
    """Log odds of the hashed predictors from all texts to learn from. Tasks send their counts, packed; the tables have a
    fixed size."""
    counted = rows.select("text", "learn").mapInArrow(_counting(code), "segment int, low binary, over binary, more binary")
    added = stage(counted.repartition("segment").mapInArrow(_adding, "segment int, odds binary"))
    table = np.zeros(sum(1 << b for b in TABLE_BITS), np.int8)
    half = SEGMENT // 2
    for segment, odds in added.collect():
        table[segment * half : (segment + 1) * half] = np.frombuffer(odds, np.int8)
    return np.split(table, np.cumsum([1 << b for b in TABLE_BITS])[:-1])


def _block_of(index: np.ndarray) -> np.ndarray:
    """Blocks of 32, 64, ... 1,024 tokens, then of 2,048 each."""
    early = np.floor(np.log2(index / 32 + 1)).astype(np.int64)
    return np.where(index < 32 * 63, early, 6 + (index - 32 * 63) // 2048)


def mixing_scores(words: Words, tables: list[np.ndarray], n: int) -> np.ndarray:
    """Decimal log probability of each text.

    The decisions of a token are at most one run of each gate; weights and sums are handled by stretches of a text's runs.
    """
    packed = np.zeros((len(words.bit), 4), np.int8)
    packed[:, :3] = words.static
    for k in range(3):
        packed[words.spelled, k] = tables[k][words.slots[k].astype(np.int64)]  # addresses of 64 bits are looked up faster
    packed[:, 3] = words.bit
    packed = packed.view(_U).ravel()
    block = _block_of(words.index)
    order = np.argsort(block, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(block[order]))])
    weights = np.tile(np.array(START_WEIGHTS, np.float32), (n, 1))
    seen = np.full(n * GATES, 60.0)
    centre = np.tile(1 / (1 + np.exp(-(np.arange(REFINED) - REFINED // 2) / 2)), n)
    zeros, ones = np.zeros(n * REFINED), np.zeros(n * REFINED)
    score = np.zeros(n)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        refined = ((ones + 40.0 * centre) / (zeros + ones + 40.0)).astype(np.float32)
        share = ((zeros + ones) / (2 * (zeros + ones + 40.0))).astype(np.float32)
        known, rated = seen.copy(), weights.copy()
        moved, both = np.zeros((3, n * GATES)), np.zeros(n * REFINED * 2, np.int64)
        # in pieces that stay in a processor's cache, by gate and text: long stretches have the same weights
        for at in range(a, b, PIECE):
            tokens = order[at : min(at + PIECE, b)]
            word = words.token[tokens]
            by_gate = words.gate_steps[word]
            start = words.first_step[word][:, None] + np.cumsum(by_gate, axis=1) - by_gate
            steps = _ranges(start.T.ravel(), by_gate.T.ravel())
            of_text = words.rows[tokens]
            edges = np.flatnonzero(np.append(True, of_text[1:] != of_text[:-1]))
            long = np.add.reduceat(by_gate, edges, axis=0).T.ravel()
            used = np.flatnonzero(long)
            long, row = long[used], of_text[edges][used % len(edges)]
            gate = row * GATES + used // len(edges)
            first = np.cumsum(long) - long
            four = packed[steps].view(np.int8).reshape(-1, 4)
            bit = four[:, 3]
            given = four[:, :3].T.astype(np.float32, order="C")
            n_head = by_gate[:, 0]
            heads = int(n_head.sum())
            node = words.node[steps[:heads]]
            for k in range(2):
                given[1 + k, :heads] = tables[3 + k][words.paired_slots(k, node, n_head, tokens).astype(np.int64)]
            given *= np.float32(1 / 16)
            z, squares = np.zeros(len(bit), np.float32), np.zeros(len(bit), np.float32)
            for k in range(3):
                z += np.repeat(rated[gate, k], long) * given[k]
                squares += given[k] * given[k]
            np.clip(z, -8, 8, out=z)
            p = np.exp(-z)
            p += 1
            np.reciprocal(p, out=p)
            cell = np.rint(z * 2).astype(np.int64)
            cell += np.repeat(row * REFINED + REFINED // 2, long)
            final = p + share[cell] * (refined[cell] - p)
            np.clip(final, 1e-5, 1 - 1e-5, out=final)
            y = bit.astype(np.float32)
            logs = np.log(np.abs(1 - y - final))
            score += np.bincount(row, np.add.reduceat(logs, first, dtype=np.float64), minlength=n)
            error = y - p
            squares *= p * (1 - p)
            known += np.bincount(gate, np.add.reduceat(squares, first, dtype=np.float64), minlength=n * GATES)
            for k in range(3):
                moved[k] += np.bincount(gate, np.add.reduceat(error * given[k], first, dtype=np.float64), minlength=n * GATES)
            both += np.bincount(cell * 2 + bit, minlength=n * REFINED * 2)
        seen = known
        for k in range(3):
            weights[:, k] += RATE * moved[k] / seen
        zeros += both[::2]
        ones += both[1::2]
    return score / np.log(10)


def context_mixing(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every document: id, counts and base score of its tokens (see ``token_counts``), ``score`` (decimal log of its
    probability), ``bits_per_byte`` (of the tokens, a space after each word).

    ``learn`` marks the rows that counts, vocabulary and tables are learned from (NULL: not). All of them count, whatever
    their number; the vocabulary is bounded, the tables have a fixed size, and both reach the tasks by broadcast (11 MB). A
    NULL or empty text has one token, its end. Rows that are equal get equal rows; an empty table gives no rows. Columns
    other than the id, the text and those in ``learn`` are not read.
    """
    rows = token_rows(docs, doc_id, text, F.coalesce(learn, F.lit(False)))
    counts = TokenCounts(rows, frequent=VOCABULARY)
    code = coding(counts)
    shared_code = docs.sparkSession.sparkContext.broadcast(code)
    tables = learned_tables(rows, shared_code)
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def score(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        words = Words(texts, shared_code.value)
        logs = mixing_scores(words, shared.value, texts.n)
        bits = -logs / np.log10(2) / words.n_bytes
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(2), pa.array(logs), pa.array(bits)], names=["id", "digest", "score", "bits_per_byte"]
        )

    kind = dict(rows.dtypes)["id"]
    scored = by_slices(rows, "text", score, f"id {kind}, digest long, score double, bits_per_byte double", SLICE)
    counted = counts.scores().dropDuplicates(["id", "digest"]).withColumnsRenamed({"id": "__id", "digest": "__digest"})
    joined = scored.join(counted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")))
    return joined.select(F.col("id").alias(doc_id), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
