"""The pipeline's stages, each on what its predecessor kept, against plain versions."""

import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import token_ids
from thicket.llm import quality_rules
from thicket.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    words = ["the", "and", "of", "to", "in", *("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400))]
    prose = lambda n: " ".join(rng.choice(words[:5] if rng.random() < 0.3 else words) for _ in range(n))
    shared, base = prose(60), prose(150)
    texts = {0: prose(100), 1: None, 2: "too short", 3: base, 4: base + "  ", 5: base.replace(" ", "\n", 3), 6: "%%% ".join(prose(90).split(" ")), 7: prose(60) + "\n" + shared, 8: shared + "\n" + prose(60), 9: prose(3000)}
    near = base.split(" ")
    near[10], near[90] = "changed", "words"
    texts[10] = " ".join(near)
    texts[11], texts[12] = "same same " * 60, texts[0]
    return texts


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus().items()], SCHEMA)
    df.repartition(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


def plain_stages():
    docs = corpus()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(docs.items()))
    passed = {r[0] for r in con.sql(f"select doc_id from ({quality_rules.sql()}) where kept").fetchall()}
    docs = {i: docs[i] for i in sorted(passed)}
    yield docs
    best = {}
    for i, t in docs.items():
        k = "".join(t.split())
        if k not in best or len(t) > len(docs[best[k]]):
            best[k] = i
    docs = {i: docs[i] for i in sorted(best.values())}
    yield docs
    docs = {i: docs[i] for i, v in brute.near_groups(docs).items() if v[2]}
    yield docs
    count, out = {}, {}
    for t in docs.values():
        for k in range(len(t) - 199):
            count[t[k : k + 200]] = count.get(t[k : k + 200], 0) + 1
    for i, t in docs.items():  # these texts are ASCII
        gone = {x for k in range(len(t) - 199) if count[t[k : k + 200]] > 1 for x in range(k, k + 200)}
        kept = "".join(c for k, c in enumerate(t) if k not in gone)
        if kept:
            out[i] = kept
    yield out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    want = list(plain_stages())
    assert [len(w) for w in want[:3]] == sorted([len(w) for w in want[:3]], reverse=True) and len(want[0]) > len(want[1]) > len(want[2])
    assert want[3] != want[2]
    for (_, stage), expected in zip(corpus_pipeline.STAGES, want):
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in rows} == expected and len(rows) == len(expected)
        assert all(r.n_chars == len(r.text) for r in rows)
        docs = spark.createDataFrame(rows, SCHEMA)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
    check_packed(packed, want[3])


def check_packed(packed, docs):
    path = tokenizer_path("byte_bpe_50k.json")
    assert {r.doc_id for r in packed} == set(docs)
    for i, t in docs.items():
        ids, own = np.array([*token_ids(path, t), 2], "<u4"), sorted((r for r in packed if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)


def test_run(spark, sf_dir):
    check_packed(QUERIES["pipeline"](spark, sf_dir).collect(), list(plain_stages())[3])


def test_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
