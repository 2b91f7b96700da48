"""The kept family of suffix arrays, and the edges of removal."""

import random

from pyspark.sql import functions as F

from tests.llm import brute
from thicket.llm import suffix_dedup


def texts(n=24):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(2, 8)))
    shared = [" ".join(word() for _ in range(rng.randint(50, 90))) for _ in range(4)]
    out = {}
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(5, 60)))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            cut = rng.randint(0, 30)
            parts.append(s[cut : len(s) - rng.randint(0, 30)])
        out[i] = " ".join(parts)
    return out | {90: None, 91: "", 92: out[3], 93: out[5][:230]}


def removed(df):
    """{doc_id: spans as (start, end)} of spans_of's rows."""
    out = {}
    for r in df.collect():
        import numpy as np

        pairs = [np.frombuffer(bytes(s), np.uint32).reshape(2, -1) for s in (r.full, r.more) if s]
        if pairs:
            a, b = suffix_dedup._union(*np.concatenate(pairs, axis=1).astype(np.int64))
            if len(a):
                out[r.doc_id] = sorted(zip(a.tolist(), b.tolist()))
    return out


def test_later_batches_join_the_levels_that_were_kept(spark):
    docs = texts()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    index = None
    for k in range(3):
        index = suffix_dedup.added(df.where(F.col("doc_id") % 3 == k), index)
        levels = index.family.where("batch < 0").count()
        assert levels >= 1
    got = removed(suffix_dedup.spans_of(index, df))
    assert got == removed(suffix_dedup.repeated_spans(df))
    want = brute.suffix_dedup(docs)
    assert {i: sum(b - a for a, b in s) for i, s in got.items()} == {i: n for i, (_, n, _, _) in want.items() if n}
    index.dropped()


def test_levels_of_equal_size_merge():
    import numpy as np

    family = suffix_dedup.Levels()
    for k in range(64):
        family.add((np.arange(8, dtype=np.uint64) + np.uint64(8 * k), np.zeros(8, np.uint64), np.zeros(8, bool)))
        assert len(family.levels) <= 7
    assert len(family.whole()[0]) == 512


def test_removal_keeps_other_columns_and_null_texts(spark):
    rng = random.Random(2)
    shared = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60))
    rows = [(1, shared + " end of one", 9, "a", 1, None, 5), (2, "start " + shared, 9, "b", 2, "x", 5), (3, None, None, "c", 3, "y", 5), (4, "", 0, "d", 4, "z", 5), (5, shared, 9, "e", 5, "w", 5), (None, "short", 5, "f", 6, "v", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, th string, full long, more string, c0 int")
    got = {r.full: r for r in suffix_dedup.without_repeats(df).collect()}
    assert suffix_dedup.without_repeats(df).columns == df.columns
    assert set(got) == {1, 2, 3, 4, 6}
    assert got[1].text == " end of one" and got[1].n_chars == 11 and got[2].text == "start "
    assert got[3].text is None and got[3].n_chars is None and got[4].text == "" and got[6].text == "short"
    assert [got[k].th for k in (1, 2, 3, 4, 6)] == ["a", "b", "c", "d", "f"]
    assert suffix_dedup.without_repeats(df.limit(0)).count() == 0
