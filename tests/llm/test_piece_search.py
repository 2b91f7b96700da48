"""Encoding of pieces looks only for what may be one."""

import random

import numpy as np

from thicket.llm import sentence_pieces
from thicket.llm.queries import tokenizer_path


def test_few_substrings_are_searched(monkeypatch):
    model, _ = sentence_pieces.loaded(tokenizer_path("piece_bpe_32k.model"))
    rng, search, sought = random.Random(7), np.searchsorted, [0]
    words = ["".join(rng.choices("etaoinshrdlu", k=10)) for _ in range(2000)]

    def counted(keys, x, *rest):
        sought[0] += np.size(x) if keys is model.keys else 0
        return search(keys, x, *rest)

    monkeypatch.setattr(np, "searchsorted", counted)
    found = model.encode_words(words)
    assert ["".join(model.pieces[i] for i in ids) for ids in found] == words
    assert 0 < sought[0] < 2000 * 55 // 2  # of 55 substrings of each
