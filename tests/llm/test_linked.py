"""Groups whose nodes share buckets but mostly no links: all right, and few pairs meet on their contents."""

import random
import re

import numpy as np
import pytest

from tests.llm import brute
from thicket.llm import linked, near_dedup

RNG = random.Random(5)
BASE = [f"w{k}" for k in range(200)]


def changed(n):
    """Copies of one text with words changed: some linked, most just not."""
    out = list(BASE)
    for at in RNG.sample(range(len(out)), n):
        out[at] = f"x{RNG.random()}"
    return " ".join(out)


FAMILY = {k: changed(14 if k % 10 else 8) for k in range(240)}


def groups(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    said: list[str] = []
    rows = near_dedup._groups(docs, say=said.append).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}, sum(int(n) for x in said for n in re.findall(r"ties (\d+)", x))


def test_pairs_without_links_seldom_meet_on_contents(spark):
    got, ties = groups(spark, FAMILY)
    assert got == brute.near_groups(FAMILY)
    assert ties < 12 * len(FAMILY)  # of 28,680 pairs


@pytest.mark.parametrize("most", [1, 1000])
def test_blocks_and_rounds_lose_nothing(spark, monkeypatch, most):
    whole = linked.linked_groups
    monkeypatch.setattr(near_dedup, "linked_groups", lambda *a: whole(*a, most=most, block_bytes=4000))
    got, _ = groups(spark, FAMILY)
    assert got == brute.near_groups(FAMILY)


def test_large_blocks_of_small_sketches_are_looked_at_in_parts(spark):
    n, at_once = 3000, 1 << 21

    def refuted(a, b):
        assert len(a) * len(b) <= at_once
        x, y = ([int.from_bytes(t, "little") for t in side] for side in (a, b))
        return np.abs(np.subtract.outer(x, y)) > 2

    open_ = spark.range(n).selectExpr("1L as bucket", "id as node", "id as component", f"{n}L as n")
    sketches = spark.createDataFrame([(k, k.to_bytes(8, "little")) for k in range(n)], "node long, sketch binary")
    met = linked._met(open_, sketches, refuted, 32, linked.BLOCK_BYTES).collect()
    assert sorted((r.v, r.u) for r in met) == sorted((k, k + d) for d in (1, 2) for k in range(n - d))
    assert not any(r.more for r in met)


def test_parities_refute_only_what_is_unlinked():
    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 5, 60, 300, 410, 2000):
        own = rng.integers(0, 1 << 52, n, dtype=np.uint64)
        for part in (1.0, 0.95, 0.89, 0.8, 0.5):
            kept = own[: max(1, int(n * part))]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 52, n - len(kept), dtype=np.uint64)])))
    sketches, said = [near_dedup.parities(x) for x in sets], 0
    refuted = near_dedup._refuted(80)(sketches, sketches)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            common = len(np.intersect1d(x, y))
            if 100 * common >= 80 * (len(x) + len(y) - common):
                assert not refuted[i, j]
            else:
                said += bool(refuted[i, j])
    assert said > 600
