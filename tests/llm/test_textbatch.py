"""Arrow columns of every kind, cut and joined."""

import numpy as np
import pyarrow as pa
import pytest

from thicket.llm.textbatch import Dictionary, balanced, cuts, pieces_before_space, text_column, word_hashes, words_of


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_cuts_keep_every_row(kind):
    texts = ["a b", None, "", "x" * 50, "c d e", None]
    batch = pa.record_batch([pa.array(texts, kind)], names=["text"])
    for part in (batch, batch.slice(1), batch.slice(2, 3)):
        for n in (1, 8, 1000):
            got = [text_column(x).to_pylist() for x in cuts(part, n)]
            assert [t for own in got for t in own] == [t or "" for t in part.column("text").to_pylist()]
            assert all(sum(map(len, own)) <= n or len(own) == 1 or not any(own[1:]) for own in got)
        joined = list(balanced(iter([part, part]), 60))
        assert [t for x in joined for t in text_column(x).to_pylist()] == 2 * [t or "" for t in part.column("text").to_pylist()]
    assert len(list(balanced(iter([batch, batch]), 10_000))) == 1 and not list(balanced(iter([]), 5))


def test_words_and_hashes():
    words, counts = words_of(pa.array(["  a bb ", "", "\t", "a\x00 a abcdefghi abcdefgh"]))
    assert words.to_pylist() == ["a", "bb", "a\x00", "a", "abcdefghi", "abcdefgh"] and counts.tolist() == [2, 0, 0, 4]
    h = word_hashes(words)
    assert len(set(h.tolist())) == 5 and h[0] == h[3] and (word_hashes(words.slice(2)) == h[2:]).all()
    assert len(word_hashes(pa.array([], pa.string()))) == 0


def test_cuts_before_white_space_in_any_script():
    pieces, counts = pieces_before_space(pa.array(["привет мир  да", "日本 語", "x　 y", "z  q", "  a"]))
    assert pieces.to_pylist() == ["привет", " мир", "  да", "日本", " 語", "x　 y", "z  q", "  a"]
    assert counts.tolist() == [3, 2, 1, 1, 1]


def test_dictionary_keeps_only_short_strings():
    seen = []
    table = Dictionary(lambda strings: seen.extend(strings) or [[len(s)] for s in strings], most=2)
    for _ in range(2):
        ids, at, size = table.look_up(pa.array(["a", "x" * 100, "bb", "a", "ccc"]))
        assert ids[at].tolist() == [1, 100, 2, 1, 3] and np.all(size == 1)
    assert len(table.number) == 2 and seen.count("a") == 1 and seen.count("x" * 100) == 2 and seen.count("ccc") == 2
