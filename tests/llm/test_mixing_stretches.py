"""Decisions are handled by stretches of a text, so their sums do not depend on how many are handled at once."""

import numpy as np
import pyarrow as pa

from regionloom.llm import context_mixing
from regionloom.llm.text import Texts


def test_scores_do_not_depend_on_the_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["zyx" * 30]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 7, 40, 300, 2500)]
    code = {
        "hashes": np.zeros(0, np.uint64),
        "words": context_mixing.code_tree(np.array([6.0, 2849.0])),
        "letters": context_mixing.code_tree(np.ones(256)),
    }
    tables = [rng.integers(-60, 60, 1 << b).astype(np.int8) for b in context_mixing.TABLE_BITS]

    def scores(piece, some):
        monkeypatch.setattr(context_mixing, "PIECE", piece)
        found = context_mixing.Words(Texts(pa.array(some)), code)
        return context_mixing.mixing_scores(found, tables, len(some))

    want = scores(1 << 12, texts)
    assert (want < 0).all() and len(want) == 6
    for piece in (1, 13, 1 << 9):
        np.testing.assert_allclose(scores(piece, texts), want, rtol=1e-6)
    np.testing.assert_allclose(np.concatenate([scores(1 << 12, [t]) for t in texts]), want, rtol=1e-6)
