"""The audit of filters against brute force over every order, and the merges of posting lists."""

import itertools
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from regionloom.llm import filter_audit as module
from regionloom.llm.filter_audit import filter_audit, galloping_overlap, galloping_union, union_sizes

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_lists = st.lists(st.integers(0, 60), unique=True).map(lambda x: np.array(sorted(x), np.int64))


@given(_lists, _lists)
@settings(max_examples=150, deadline=None)
def test_galloping_merges(one, other):
    assert list(galloping_union(one, other)) == sorted(set(one) | set(other))
    assert galloping_overlap(one, other) == len(set(one) & set(other))


@given(st.lists(_lists, min_size=3, max_size=3), _lists, _lists)
@settings(max_examples=60, deadline=None)
def test_union_sizes(lists, good, toxic):
    sizes = union_sizes(lists, good, toxic)
    for s in range(8):
        union = set().union(*[set(lists[k]) for k in range(3) if s >> k & 1])
        assert tuple(sizes[s]) == (len(union), len(union & set(good)), len(union & set(toxic)))


def brute_force(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    parts = {}
    for doc_id, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            f
            for f, bad in zip(
                "ABCDE",
                (
                    len(words) < 200,
                    100 * len(set(words)) < 50 * len(words),
                    100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                    bool(re.search(r"[#$%&*|]", t)),
                    doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in docs),
                ),
                strict=True,
            )
            if bad
        }
        parts.setdefault(lang or "", []).append((doc_id, fails))
    rows = []
    for part, members in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                removed = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(removed)
                failing = sum(f in m[1] for m in members)
                lost = [sum(m[0] in ids for m in removed) for ids in (good, toxic)]
                steps.append([part, "".join(order), step, len(left), len(removed), failing - len(removed), sum(m[1] == {f} for m in members), *lost, f])
        rows += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(rows)


def test_audit_is_that_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "RANGE_ROWS", 7)
    random.seed(1)
    docs = []
    for i in range(150):
        words = [random.choice(["word", "Other", "thing", "#", "x%", "é"]) + str(random.randrange(300)) for _ in range(random.choice([3, 190, 210, 400]))]
        docs.append((i, random.choice(docs)[1] if i > 5 and i % 4 == 0 else " ".join(words), random.choice(["en", "de", None, ""])))
    docs += [(7, docs[7][1], "en"), (200, None, "en"), (201, "", "de"), (202, None, None), (None, docs[3][1], "en"), (None, "only here", "en")]
    docs += [(300 + i, " no space\x00 here " * 3000, "fr") for i in range(3)]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, lang string, part int, n int, quality int")
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit(df, lb)
    assert out.columns == COLUMNS
    assert sorted(tuple(r) for r in out.collect()) == brute_force(docs, [x for x in labels if x[0] is not None])


def test_no_documents_and_no_labels(spark, odd_documents, no_documents, some_labels):
    assert filter_audit(no_documents, some_labels).collect() == []
    rows = filter_audit(odd_documents, some_labels.limit(0)).collect()
    assert len(rows) == 600 * 3 and all(r.good_lost == 0 for r in rows)
