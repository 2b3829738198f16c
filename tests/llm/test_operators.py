"""The operators against brute force on small tables, and on odd rows."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def rows_of(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, FOLDER).collect()}


# ---------------------------------------------------------------- mixing


@here
def test_mixture_meets_its_targets(spark, documents):
    source = {r.doc_id: r.source for r in documents.collect()}
    found = rows_of(spark, "op1_mixing")
    sizes, taken, targets = Counter(), Counter(), {}
    for i, r in found.items():
        sizes[source[i]] += r.size
        taken[source[i]] += r.taken
        targets[source[i]] = r.target
        assert r.taken <= 3 * r.size and r.source_size
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    capped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        level = rest / sum(weights[s] for s in sizes if s not in capped)
        more = {s for s in sizes if s not in capped and level * weights[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in sizes:
        assert math.isclose(targets[s], 3 * sizes[s] if s in capped else level * weights[s], rel_tol=1e-9)
        biggest = max(r.size for i, r in found.items() if source[i] == s)
        assert abs(taken[s] - targets[s]) <= biggest / 2 + 1
    again = rows_of(spark, "op1_mixing")
    assert found == again


def test_mixture_caps_small_sources(spark):
    from regionloom.llm.mixing import mixed_documents, mixture

    rows = [(i, " ".join(["w"] * (i % 7 + 1)), "abc"[min(i // 5, 2)]) for i in range(300)] + [(1000 + i, "x y", None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixture(docs, weights=(50, 1, 1)).toPandas().merge(docs.toPandas())
    by = found.groupby("source", dropna=False).agg(taken=("taken", "sum"), size=("size", "sum"), target=("target", "first"))
    assert by.loc["a", "taken"] == 3 * by.loc["a", "size"] == by.loc["a", "target"]
    assert abs(by["target"].sum() - by["size"].sum()) < 1e-6
    assert (by["taken"] - by["target"]).abs().max() <= 4
    copies = mixed_documents(docs, weights=(50, 1, 1)).groupBy("doc_id").count().collect()
    epochs = dict(zip(found["doc_id"], found["epochs"], strict=True))
    assert {r.doc_id: r["count"] for r in copies} == {i: e for i, e in epochs.items() if e}


# ---------------------------------------------------------------- line dedup


def test_templates_generalise_fields(spark):
    from regionloom.llm.line_templates import without_recurring_lines

    docs = [(i, f"own text number of {'abcdefgh'[i]} alone here\nPage {i} of 10 was printed at {i}:30 today\nServer alpha got request from {n} again now") for i, n in enumerate(["bob", "eve", "ann", "joe"])]
    docs += [(9, "Server alpha got request from nobody at all now")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id: r.text.split("\n") for r in without_recurring_lines(frame).collect()}
    assert len(kept[0]) == 3 and all(len(kept[i]) == 1 for i in (1, 2, 3)) and len(kept[9]) == 1


def test_lines_of_two_documents_and_short_lines_recur(spark):
    from regionloom.llm.line_templates import without_recurring_lines

    shared = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs = [
        (1, f"first own line here\n{shared}\nLes.\n\nPage 3\nYes  indeed"),
        (2, f"second text of another kind\n{shared}\nLes.\n\nPage 4\n Yes\tindeed\nNo"),
        (3, "third alone\nLes.\nLes.\n\nPage 3"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in without_recurring_lines(frame).collect()}
    assert kept == {1: docs[0][1], 2: "second text of another kind\n\nPage 4\nNo", 3: "third alone\n"}


def test_distinct_lines_with_the_same_start_stay(spark):
    from regionloom.llm.line_templates import without_recurring_lines

    docs = [(i, f"It was the {w}\n12 4{i} 78\nthe report of {w} {i}\n{i} apples and {i} pears") for i, w in enumerate(["best", "worst", "age", "end"])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id: r.text.split("\n") for r in without_recurring_lines(frame).collect()}
    assert kept == {i: t.split("\n")[: 4 if i == 0 else 3] for i, t in docs}


# ---------------------------------------------------------------- language model


@here
def test_context_mixing_counts_and_gain(spark, texts):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = {i: [*WORD.findall((t or "").translate(lower)), "\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    found = rows_of(spark, "op3_context_mixing")
    for i, r in found.items():
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i])
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-6)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n, held[i])
        assert r.score < 0
    # ten times as many texts to learn from
    larger = queries.QUERIES["op3_context_mixing"](spark, "/root/testdata/sf0.01").where("held_out")
    score, base = larger.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > 0.9 * base


def test_code_trees_are_probabilities():
    from regionloom.llm.context_mixing import code_tree

    counts = np.array([5, 1, 1, 3, 90])
    tree = code_tree(counts)
    for s, c in enumerate(counts):
        path = slice(tree["first"][s], tree["first"][s] + tree["length"][s])
        odds, bit = tree["odds"][path] / 16, tree["bit"][path]
        p = np.prod(1 / (1 + np.exp(np.where(bit == 1, -odds, odds))))
        assert math.isclose(p, c / counts.sum(), rel_tol=0.2)


# ---------------------------------------------------------------- classifiers


@here
@pytest.mark.parametrize("name", ["op4_line_crf", "op10_quality_rules"])
def test_classifiers_on_held_out_rows(spark, name):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    found = rows_of(spark, name)
    if name == "op4_line_crf":
        pairs = [(labels[i], r.predicted) for i, r in found.items() if i in labels and r.held_out]
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
        assert {i: r.held_out for i, r in found.items()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in found}
    else:
        pairs = [(labels[i], int(r.kept)) for i, r in found.items() if i in labels and not r.base_failed]
    assert sum(a == b for a, b in pairs) >= 0.9 * len(pairs)


@here
def test_rules_count_exactly(spark, texts):
    for i, r in rows_of(spark, "op10_quality_rules").items():
        text = texts[i] or ""
        words, seen, repeats = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                repeats += line in seen
                seen.add(line)
        runs = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        inside = set()
        for k in range(len(words) - 4):
            if runs[tuple(words[k : k + 5])] > 1:
                inside |= set(range(k, k + 5))
        wanted = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(inside))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == wanted
        assert r.base_failed == (len(words) < 10 or 100 * len(inside) > 20 * len(words))
        assert not (r.base_failed and r.kept)


def test_marginals_are_those_of_all_labellings():
    from itertools import product

    from regionloom.llm.line_crf import Chains

    rng = np.random.default_rng(3)
    rows = np.array([0, 0, 0, 0, 1, 2, 2])
    good, moves = rng.normal(size=7), rng.normal(size=(2, 2))
    found, expected, _ = Chains(rows).marginals(good, moves)
    wanted, seen = np.zeros(7), np.zeros((2, 2))
    for row in (0, 1, 2):
        at = np.flatnonzero(rows == row)
        weights = {}
        for labels in product((0, 1), repeat=len(at)):
            score = sum(good[a] for a, y in zip(at, labels, strict=True) if y) + sum(moves[x, y] for x, y in zip(labels, labels[1:], strict=False))
            weights[labels] = math.exp(score)
        total = sum(weights.values())
        for labels, w in weights.items():
            wanted[at] += np.array(labels) * w / total
            for x, y in zip(labels, labels[1:], strict=False):
                seen[x, y] += w / total
    assert np.allclose(found, wanted) and np.allclose(expected, seen)


# ---------------------------------------------------------------- near duplicates


def classes_by_force(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if (both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)) or texts[a] == texts[b]:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@here
def test_near_duplicates_by_force(spark, texts):
    assert {i: r.class_id for i, r in rows_of(spark, "op5_prob_minhash").items()} == classes_by_force(texts)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Chains and clouds of near copies, with buckets dealt in small blocks."""
    from regionloom.llm import prob_minhash

    monkeypatch.setattr(prob_minhash, "FEW", 4)
    monkeypatch.setattr(prob_minhash, "BLOCK", 8)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(40):
        copy = list(base)
        for at in rng.choice(200, 3 + i % 3, replace=False):
            copy[at] = f"x{i}_{at}"
        texts[i] = " ".join(copy)
    chain = [f"c{i}" for i in range(300)]
    for i in range(12):
        texts[100 + i] = " ".join(chain[i * 8 : i * 8 + 200])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(docs).collect()}
    assert found == classes_by_force(texts)
    kept = prob_minhash.without_near_duplicates(docs).collect()
    assert {r.doc_id for r in kept} == set(found.values())


def test_signatures_estimate_probability_jaccard():
    from regionloom.llm.prob_minhash import signatures
    from regionloom.llm.text import mixed

    a = {k: 1.0 + k % 3 for k in range(60)}
    b = {k: 1.0 + (k + 1) % 2 for k in range(20, 90)}
    wanted = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
    agree = []
    for seed in range(60):
        hashes = mixed(np.array([*a, *b], np.uint64) + np.uint64(1000 * seed))
        rows = np.array([0] * len(a) + [1] * len(b))
        kept = signatures(hashes, rows, np.array([*a.values(), *b.values()]), 2)
        agree.append((kept[0] == kept[1]).mean())
    assert abs(np.mean(agree) - wanted) < 0.02


def test_near_copies_with_a_line_repeated_hundreds_of_times(spark):
    """Pairs of plain similarity 0.8 to 0.92, where one text repeats a few shingles often."""
    from regionloom.llm.prob_minhash import near_duplicates

    texts = {}
    for k in range(60):
        base = " ".join(f"w{k}_{i}" for i in range(104))
        size, times = ((6, 200), (20, 20), (16, 300))[k % 3]
        line = " ".join(f"x{k}_{i}" for i in range(size))
        texts[2 * k], texts[2 * k + 1] = base, "\n".join([base, *[line] * times])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert found == classes_by_force(texts) == {i: i - i % 2 for i in texts}


def test_components_of_a_long_path(spark):
    from regionloom.llm.components import components

    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 501)], "a long, b long"))
    roots = {r.v: r.root for r in components(links).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and roots[500] == roots[501] != roots[0]


# ---------------------------------------------------------------- suffix order


def removed_by_force(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone, own = bytearray(len(data)), []
        for k in range(len(data) - 49):
            own.append(data[k : k + 50])
            if data[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@here
def test_repeated_strings_by_force(spark, texts):
    found = rows_of(spark, "op6_suffix_dedup")
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in found.items()} == removed_by_force(texts)


def test_repeated_strings_of_few_letters(spark):
    from regionloom.llm.suffix_dedup import repeated_strings

    rng = np.random.default_rng(1)
    pieces = ["a" * 70, "ab" * 40, "".join(rng.choice(list("abc"), 90)), "".join(rng.choice(list("ab"), 55)), "é" * 30]
    texts = {i: "".join(pieces[k][int(rng.integers(0, 9)) :] for k in rng.integers(0, len(pieces), 4)) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_strings(docs).collect()}
    assert found == removed_by_force(texts)


def test_suffix_array_by_sorting():
    from regionloom.llm.suffixes import suffix_array

    rng = np.random.default_rng(2)
    for n in [*range(30), 200]:
        for letters in (1, 2, 5):
            text = rng.integers(1, letters + 1, n)
            assert suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


# ---------------------------------------------------------------- pieces


def small_vocabulary():
    from regionloom.llm.pieces import Pieces

    scores = {b"a": -900, b"b": -950, b" ": -700, b"aa": -1500, b"ab": -1400, b"aab": -2200, b" a": -1200, b"ba": -1600, b"abab": -2600, b"\xc3\xa9": -800}
    return Pieces.of(scores)


@pytest.mark.parametrize("chunk", [7, 16, 1000])
def test_chunks_change_nothing(spark, chunk):
    from regionloom.llm.pieces import _traced, best_path, decode, encode

    rng = np.random.default_rng(4)
    texts = {i: "".join(rng.choice(list("aaabb é▁\n"), int(rng.integers(0, 60)))) for i in range(80)}
    texts[99] = "ab" * 300
    vocabulary = small_vocabulary()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = decode(encode(docs, chunk=chunk, vocabulary=vocabulary), vocabulary=vocabulary).collect()
    assert len(found) == len(texts)
    for r in found:
        data = (" " + texts[r.doc_id]).encode()
        best, last = best_path(data, {0: 0}, vocabulary, len(data))
        assert (r.decoded, r.score, list(r.ids)) == (texts[r.doc_id], best[len(data)], _traced(last, len(data)).tolist())


def test_max_plus_is_associative():
    from regionloom.llm.pieces import max_plus

    rng = np.random.default_rng(6)
    a, b, c = (rng.integers(-50, 0, (5, 5)) for _ in range(3))
    assert (max_plus(max_plus(a, b), c) == max_plus(a, max_plus(b, c))).all()


@here
def test_public_pieces_round_trip(spark, texts):
    found = rows_of(spark, "op7_pieces")
    assert {i: r.decoded_sha256 for i, r in found.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}


# ---------------------------------------------------------------- fingerprints


@here
def test_fingerprints_of_edits(spark, texts):
    found, ids = rows_of(spark, "op8_fingerprints"), sorted(texts)
    errors = []
    for k, i in enumerate(ids):
        text, following = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        assert found[i].n_chars == len(text) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = (set(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for w in (WORD.findall(text), WORD.findall(edited)))
        errors.append(abs(len(a & b) / max(1, len(a | b)) - found[i].near_edited))
    assert np.mean(errors) < 0.1
    by_text = defaultdict(set)
    for i in ids:
        by_text[texts[i]].add(found[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_ranges_of_ids_follow_each_other(spark, monkeypatch):
    from regionloom.llm import neighbours_by_id

    monkeypatch.setattr(neighbours_by_id, "ROWS_IN_RANGE", 3)
    ids = [int(x) for x in np.unique(np.random.default_rng(8).integers(-(10**12), 10**12, 50))] + [2**62]
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    dealt, order = neighbours_by_id.in_ranges(docs, "doc_id")
    found = dealt.withColumn("next", F.lead("text").over(order)).where("NOT __guest").collect()
    ids = sorted(ids)
    assert {r.doc_id: r.next for r in found} == {i: str(n) for i, n in zip(ids, ids[1:] + ids[:1], strict=True)}


# ---------------------------------------------------------------- licenses


def licenses_of(spark, docs):
    from regionloom.llm.licenses import license_scan

    rows = license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return {(r.doc_id, r.license): r for r in rows}


def test_every_template_is_found_inside_a_text(spark):
    from regionloom.llm.license_texts import TEMPLATES

    filler = " ".join(f"filler{i}" for i in range(500))
    found = licenses_of(spark, [(k, f"{filler[: 40 * k]} {t.text.upper() if k % 2 else t.text} {filler}") for k, t in enumerate(TEMPLATES)])
    assert {(k, t.license) for k, t in enumerate(TEMPLATES)} == set(found)
    assert all(r.containment == 1.0 for r in found.values())


def test_edited_texts_and_near_relatives(spark):
    """Versions and kinds are told apart although most of their words are the same."""
    from regionloom.llm.license_texts import TEMPLATES

    gpl = max((t.text for t in TEMPLATES if t.license == "GPL-3.0"), key=len)
    mit = max((t.text for t in TEMPLATES if t.license == "MIT"), key=len)
    bsd = [max((t.text for t in TEMPLATES if t.license == name), key=len) for name in ("BSD", "BSD-2-Clause", "BSD-3-Clause")]
    docs = [
        (1, "This work is licensed under the GNU General Public License, version 2."),
        (2, "This work is licensed under the GNU General Public License, version 1."),
        (3, gpl.replace("program", "package")),
        (4, gpl.replace("GNU General", "GNU Affero General")),
        (5, gpl.replace("version 3", "version 4")),
        (6, mit.replace("merge, publish", "publish").replace("the Software without", "it without")),
        (7, " ".join(bsd)),
        (8, " ".join(bsd[:2])),
        (9, "# SPDX-License-Identifier: MIT\ncode"),
        (10, "/* SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0-only) */ and SPDX-License-Identifier: MIT"),
        (11, "Released under the"),
        (12, None),
        (13, ""),
        (14, "Apache MIT GPL version 3 license"),
    ]
    found = licenses_of(spark, docs)
    want = {(1, "GPL-2.0"), (3, "GPL-3.0"), (4, "AGPL-3.0"), (6, "MIT"), (7, "BSD-3-Clause"), (8, "BSD-2-Clause"), (9, "MIT")}
    assert set(found) == want | {(10, "Apache-2.0"), (10, "GPL-2.0-only"), (10, "MIT")}
    assert 0.8 <= found[3, "GPL-3.0"].containment < 1 and found[9, "MIT"].first_word == 0


def test_a_whole_license_text_in_a_long_document(spark):
    from regionloom.llm.license_texts import TEMPLATES

    text = "\n\n".join(t.text for t in TEMPLATES if t.license == "Apache-2.0")
    found = licenses_of(spark, [(1, "word " * 200_000 + text + " word" * 200_000)])
    assert set(found) == {(1, "Apache-2.0")} and found[1, "Apache-2.0"].first_word == 200_000


# ---------------------------------------------------------------- odd rows


def test_odd_rows_and_no_rows(spark, odd_documents, no_documents, some_labels):
    from regionloom.llm.context_mixing import context_mixing
    from regionloom.llm.fingerprints import edits_and_successors, fingerprints
    from regionloom.llm.licenses import license_scan
    from regionloom.llm.line_crf import good_documents, line_field_quality
    from regionloom.llm.line_templates import without_recurring_lines
    from regionloom.llm.mixing import mixed_documents, mixture
    from regionloom.llm.pieces import decode, encode
    from regionloom.llm.prob_minhash import near_duplicates, without_near_duplicates
    from regionloom.llm.quality_rules import quality_rules
    from regionloom.llm.suffix_dedup import repeated_strings

    none = some_labels.limit(0)
    operators = {
        "mixture": mixture,
        "context": lambda d: context_mixing(d, F.col("doc_id") % 2 == 0),
        "crf": lambda d: line_field_quality(d, some_labels),
        "crf without labels": lambda d: line_field_quality(d, none),
        "lines": without_recurring_lines,
        "near": near_duplicates,
        "strings": repeated_strings,
        "pieces": lambda d: decode(encode(d)),
        "prints": fingerprints,
        "edits": edits_and_successors,
        "rules": lambda d: quality_rules(d, some_labels),
        "rules without labels": lambda d: quality_rules(d, none),
    }
    n = odd_documents.count()
    made = {name: operator(odd_documents).collect() for name, operator in operators.items()}
    assert {name: len(rows) for name, rows in made.items()} == dict.fromkeys(operators, n)
    for name, operator in operators.items():
        assert operator(no_documents).count() == 0, name
    assert license_scan(odd_documents).count() == license_scan(no_documents).count() == 0
    near = {(r.doc_id, r.class_id) for r in made["near"]}
    assert {(1, 1), (2, 1), (9, 1), (None, 1), (3, 3), (4, 3)} <= near
    assert {r.decoded for r in made["pieces"] if r.doc_id in (3, 4)} == {""}
    assert sum(r.size for r in made["mixture"] if r.doc_id == 3) == 0
    for f in (without_near_duplicates, mixed_documents, lambda d: good_documents(d, some_labels), without_recurring_lines):
        assert f(odd_documents).columns[: len(odd_documents.columns)] == odd_documents.columns
        assert f(no_documents).count() == 0
