"""Rows without an id keep their texts, and their repeats go, in every operator that removes."""

import random

from thicket.llm import exact_dedup, line_dedup, near_dedup, suffix_dedup

SCHEMA = "doc_id long, text string"


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_exact(spark):
    a, b, c = prose(9, 1), prose(9, 2), prose(9, 3)
    got = exact_dedup.kept_documents(frame(spark, [(None, a), (1, a), (None, a), (None, b), (None, c), (2, c + " ")])).collect()
    assert sorted(r.text for r in got) == sorted([a, b, c + " "])


def test_near(spark):
    a, b = prose(60, 1), prose(60, 2)
    got = near_dedup.near_dedup(frame(spark, [(None, a), (None, a + " more"), (None, b), (7, b + " other")])).collect()
    assert len(got) == 2 and {r.doc_id for r in got} == {None, 7}


def test_suffix(spark):
    shared = prose(80, 1)
    rows = [(None, prose(50, 2) + shared), (3, shared + prose(50, 4))]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    assert got[None] >= len(shared) and got[3] >= len(shared)


def test_lines(spark):
    a, b = prose(20, 1), prose(20, 2)
    rows = [(None, a), (None, b), (1, a[:-1] + "z"), (2, b + "\n" + a), (None, a + "\nx")]
    got = sorted((r.doc_id or 0, r.n_removed) for r in line_dedup.line_report(frame(spark, rows)).collect())
    assert got == [(0, 0), (0, 0), (0, 1), (1, 1), (2, 2)]
