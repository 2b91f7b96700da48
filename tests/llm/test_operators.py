"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns, against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from thicket.llm import exact_dedup, near_dedup, packing, quality_model, quality_rules, sentence_pieces, suffix_dedup, token_counts, virtual_slots
from thicket.llm.queries import tokenizer_path
from thicket.llm.textbatch import Dictionary

SCHEMA = "doc_id long, text string, lang string, n_words long, node string, bucket int, content binary, size string, digest string, words int"


def texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéßç") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(60), prose(120).split(" ")
    out = {0: None, 1: "", 2: " \t\n ", 3: "one", 4: "One", 5: prose(70), 6: prose(70) + "\n" + passage, 7: passage + " " + prose(40), 8: "ab " * 400, 9: "x" * 900, 10: prose(30_000), 11: "á \U0001f389 <|endoftext|> end", 12: "  lead  and trail  "}
    for k in range(6):  # near copies
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out[20 + k] = " ".join(copy)
    out[30], out[31], out[32] = out[5], out[5] + " ", out[5].replace(" ", "  ")
    out[40] = "\n".join(["the same line of words that repeats here"] * 12)
    out[41] = " ".join(f"{w}%%%" for w in prose(80).split(" "))
    out[42] = "the and of to in " * 3 + prose(60)
    return out


TEXTS = texts()
TWICE = (5, 3)  #: ids whose rows come twice


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in TEXTS.items()] + [(i, TEXTS[i]) for i in TWICE]
    return spark.createDataFrame([(i, t, "en", 1, "n", 2, b"c", "s", "d", 3) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def table(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def expected(values):
    return sorted([(i, *v) for i, v in values.items()] + [(i, *values[i]) for i in TWICE])


def test_exact_dedup(docs, empty):
    rows = [(i, t or "") for i, t in TEXTS.items()] + [(i, TEXTS[i]) for i in TWICE]
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256("".join(c for c in t if c not in " \t\n\x0b\x0c\r").encode()).hexdigest()].append((-len(t), i))
    want = sorted((i, min(g)[1], len(g), i == min(g)[1], d) for d, g in groups.items() for _, i in g)
    for load in (None, F.lit(True), F.lit(False), F.col("doc_id") < 25):
        assert table(exact_dedup.exact_dedup(docs, load), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {w[1] for w in want}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_loads_onto_an_index(spark, docs):
    first, second = docs.where("doc_id < 25"), docs.where("doc_id >= 25")
    fresh, index = exact_dedup.append_load(first, exact_dedup.build_index(exact_dedup.groups_of(exact_dedup.digests(first.limit(0)))))
    norm = lambda i: "".join((TEXTS[i] or "").split())
    assert {norm(r.doc_id) for r in fresh.collect()} == {norm(i) for i in TEXTS if i < 25}
    fresh, index = exact_dedup.append_load(second, index)
    assert {r.doc_id for r in fresh.collect()} == {i for i in TEXTS if i >= 25 and norm(i) not in {norm(j) for j in TEXTS if j < 25}}
    assert sum(len(r.slots) + len(r.beside) for r in index.collect()) == len({norm(i) for i in TEXTS})


def test_equal_hashes_of_different_digests_lose_nothing(spark, monkeypatch):
    real = exact_dedup.digests
    monkeypatch.setattr(exact_dedup, "digests", lambda docs: real(docs).withColumn("h", F.xxhash64(F.lit(1))))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "c", "a ", "b", "d"])], "doc_id long, text string")
    for load in (F.col("doc_id") < 3, F.col("doc_id") >= 3, F.lit(True)):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df, load).collect()}
        assert got == {0: (3, 2), 3: (3, 2), 1: (1, 2), 4: (1, 2), 2: (2, 1), 5: (5, 1)}


def test_one_row_of_each_group_is_kept(spark):
    rows = [(1, "same text"), (1, "other one"), (0, "same text"), (7, "twice"), (7, "twice"), (None, "x y"), (None, "xy"), (None, "x y"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, keep_id int, whole string")
    kept = exact_dedup.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect()) == [(-1, ""), (-1, "x y"), (0, "same text"), (1, "other one"), (7, "twice")]


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(2)
    for m in (1, 2, 3, 50, 1200):
        h = np.unique(rng.integers(-(1 << 63), 1 << 63, m))
        _, slot = exact_dedup.perfect_hash(h)
        assert sorted(slot) == list(range(len(h)))


def test_near_groups(docs, empty):
    want = brute.near_groups(TEXTS)
    assert table(near_dedup.near_groups(docs), "doc_id", "n_shingles", "component_id", "kept") == expected(want)
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if v[2]}
    assert near_dedup.near_groups(empty).count() == 0


def test_near_groups_of_a_wide_family(spark):
    """Chains and borders in one bucket: links that no leader of the first round shows."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(200)]
    own, copy = {}, list(base)
    for i in range(40):
        if i % 8 == 0:
            copy = list(base)
        for _ in range(4):
            copy[rng.randrange(200)] = rng.choice(words)
        own[i] = " ".join(copy)
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(df).collect()}
    assert got == brute.near_groups(own)


def test_min_max_values_estimate_similarity():
    a, b = pa.array([" ".join(f"a{k}" for k in range(300))]), pa.array([" ".join(f"a{k}" for k in range(100, 400))])
    (x, n), (y, m) = near_dedup.shingles(a), near_dedup.shingles(b)
    same = near_dedup.signatures(x, n, 2000) == near_dedup.signatures(y, m, 2000)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs(same.mean() - true) < 0.03 and abs(same[:, ::2].mean() - same[:, 1::2].mean()) < 0.06


def test_suffix_dedup(docs, empty):
    rows = {(i, k): TEXTS[i] for i in TEXTS for k in range(1 + (i in TWICE))}
    want = sorted((i, *v) for (i, _), v in brute.suffix_dedup(rows).items())
    assert sum(w[2] for w in want) > 3000
    assert table(suffix_dedup.suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert left[42] == TEXTS[42] and 5 not in left and len(left[10]) == len(TEXTS[10])
    assert left[0] is None and left[1] == ""


@pytest.mark.parametrize("length", [80, 319])
def test_suffix_dedup_in_small_runs(spark, monkeypatch, length):
    rng = random.Random(length)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(50, 500))) for _ in range(8)]
    own = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for i in range(40)}
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(df, length).collect()}
    assert got == brute.suffix_dedup(own, length)


def test_levels_merge_geometrically():
    rng = np.random.default_rng(4)
    family, seen = suffix_dedup.Levels(), Counter()
    for _ in range(33):
        key, sub = rng.integers(0, 30, 20).astype(np.uint64), rng.integers(0, 3, 20).astype(np.uint64)
        seen.update(zip(key.tolist(), sub.tolist()))
        order, first, count = suffix_dedup._distinct(key, sub)
        family.add((key[order][first], sub[order][first], count > 1))
        assert len(family.levels) <= 7
    k, s, many = family.whole()
    assert {(int(a), int(b)): bool(m) for a, b, m in zip(k, s, many)} == {x: n > 1 for x, n in seen.items()}
    assert sorted(zip(k, s)) == list(zip(k, s))


def test_quality_rules(docs, empty):
    import duckdb

    rows = [(i, t) for i, t in TEXTS.items()] + [(i, TEXTS[i]) for i in TWICE]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, t) for i, t in TEXTS.items()])  # the SQL needs distinct ids
    found = con.sql(quality_rules.sql())
    want = {r[0]: r[1:] for r in found.fetchall()}
    df = quality_rules.quality_report(docs)
    assert sorted(df.columns) == sorted(found.columns)
    assert table(df, *found.columns) == sorted((i, *want[i]) for i, _ in rows)
    one = {r.doc_id: r for r in df.collect()}
    assert one[42].kept and not one[41].kept and one[40].base_failed and one[0].base_failed and one[8].n_repeat_words == 400
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if one[i].kept)
    assert quality_rules.quality_report(empty).count() == 0


def token_ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


ODD = ["", "a  b\n\n c<|endoftext|> d", "  x é  y　 z", "it's  'll", "日本 語 ok", "\x1c a\x85 b", "né e’s  ñ", "ΑΣ Σας", "áb é", "<|startoftext|> A", "\x00 \x7f z", "don't we'LL", "1234 5,6"]


def test_token_counts(docs, empty):
    path = tokenizer_path("word_bpe_49k.json")
    want = {i: (len((t or "").encode()), n := len(token_ids(path, t)), n > 20) for i, t in TEXTS.items()}
    assert table(token_counts.token_counts(docs, path, limit=20, batch_bytes=1000), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected(want)
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_counts_of_odd_texts(spark):
    path = tokenizer_path("word_bpe_49k.json")
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    assert [n for _, n in table(token_counts.token_counts(df, path), "doc_id", "n_tokens")] == [len(token_ids(path, t)) for t in ODD]


def test_piece_ids_are_the_librarys():
    path = tokenizer_path("byte_bpe_50k.json")
    own = [*ODD, *(t or "" for t in TEXTS.values())]
    ids, n = packing.encoded(pa.array(own), path, None)
    at = np.concatenate([[0], np.cumsum(n)])
    for k, t in enumerate(own):
        assert ids[at[k] : at[k + 1]].tolist() == token_ids(path, t), t[:50]


def test_packing(docs, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    out = packing.pack_documents(docs, path).toPandas()
    rows = Counter(out[out.piece == 0].doc_id)
    assert rows == Counter({i: 1 + (i in TWICE) for i in TEXTS})
    for i, own in out.groupby("doc_id"):
        ids = np.array([*token_ids(path, TEXTS[i]), 2], "<u4")
        own = own.drop_duplicates("piece").sort_values("piece")
        assert own.start.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and own.length.sum() == len(ids)
        assert own.length.max() <= 1024 and (len(own) == 1 or set(own.length[1:]) == {1024})
        assert all(zlib.crc32(ids[s : s + k].tobytes()) == c for s, k, c in zip(own.start, own.length, own.ids_crc32))
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and own.length.sum() <= 1024
    assert out.sequence_id.nunique() <= packing.lower_bound(np.bincount(out.length, minlength=1025)) + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_exchange_of_gaps(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1024, 3000)
    df = spark.createDataFrame([(i, 0, 0, int(x), 0) for i, x in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.packed(df, group=400).toPandas()
    assert len(out) == 3000 and sorted(out.length) == sorted(lengths)
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and own.length.sum() <= 1024
    bound = packing.lower_bound(np.bincount(lengths, minlength=1025))
    assert bound <= out.sequence_id.nunique() <= bound + 12


def test_certified_groups_close(spark, monkeypatch):
    """Perfect halves: every group meets its bound in the first round, so there is no exchange."""
    rounds = []
    real = packing._round
    monkeypatch.setattr(packing, "_round", lambda *a: rounds.append(a[1]) or real(*a))
    df = spark.createDataFrame([(i, 0, 0, 512, 0) for i in range(2000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.packed(df, group=200)
    n = out.select("sequence_id").distinct().count()
    assert 1000 <= n <= 1005 and len(rounds) <= 3
    hard = spark.createDataFrame([(i, 0, 0, 380 + i % 3, 0) for i in range(600)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert packing.packed(hard, group=100).select("sequence_id").distinct().count() == 300


def test_lower_bound_is_one():
    rng = np.random.default_rng(5)
    for _ in range(50):
        lengths = rng.integers(1, 1025, rng.integers(0, 40))
        _, _, filled = packing.best_fit(lengths)
        assert packing.lower_bound(np.bincount(lengths, minlength=1025)) <= len(filled)
    assert packing.lower_bound(np.bincount([600] * 10, minlength=1025)) == 10
    assert packing.lower_bound(np.bincount([400] * 10, minlength=1025)) == 5


def test_sentence_pieces(docs, empty):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = {i: library.encode(t or "") for i, t in TEXTS.items()}
    got = {r.doc_id: r for r in sentence_pieces.encoded(docs, path).collect()}
    assert {i: r.ids for i, r in got.items()} == ids
    back = {r.doc_id: r.text for r in sentence_pieces.decoded(sentence_pieces.encoded(docs, path), path).collect()}
    assert back == {i: t or "" for i, t in TEXTS.items()}
    want = {i: (len((t or "").encode()), len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()), True) for i, t in TEXTS.items()}
    assert table(sentence_pieces.piece_report(docs, path), "doc_id", "n_bytes", "n_pieces", "ids_crc32", "round_trip") == expected(want)
    assert sentence_pieces.piece_report(empty, path).count() == 0


def test_merged_pieces_are_one_path():
    """The library's ids by Viterbi over a BPE file, on random strings of many scripts and on long words."""
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model, table_ = sentence_pieces.loaded(path)
    assert model.kind == sentence_pieces.BPE and model.whole.all()
    rng = random.Random(9)
    alphabets = ["ab", "abc ", "aeiou tnrs", "ABab01 .,", "привет мир ", "日本語テキスト", "  \n\t a", "the in on er re", "αβγ é ñ \U0001f389 x", "!?-_=+*#"]
    own = ["".join(rng.choice(a) for _ in range(rng.randint(0, 80))) for a in alphabets for _ in range(150)] + ["日本語" * 4000, "ab0c" * 3000, "слово" * 2000, *ODD]
    ids, n = model.encode(pa.array(own), table_)
    at = np.concatenate([[0], np.cumsum(n)])
    for k, want in enumerate(library.encode(own)):
        assert ids[at[k] : at[k + 1]].tolist() == want, own[k][:60]


def as_unigram(data):
    """The same pieces as a unigram model with scores like those of one; both lie in fields of a fixed size."""
    import struct

    at = data.index(b"\x18\x02\x20\x80\xfa\x01")
    out, i, k = bytearray(data[:at] + b"\x18\x01" + data[at + 2 :]), 0, 0
    while out[i] == 0x0A:  # a piece: its name, then its score
        size, name = out[i + 1], out[i + 3]
        assert size < 128 and out[i + 2] == 0x0A and out[i + 4 + name] == 0x15
        struct.pack_into("<f", out, i + 5 + name, -2 - (k * 7919 % 32003) / 4096)  # sums are exact in 32 bits
        i, k = i + 2 + size, k + 1
    assert k == 32000
    return bytes(out)


def test_viterbi_is_the_librarys():
    import sentencepiece

    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        unigram = as_unigram(f.read())
    model, library = sentence_pieces.Model(unigram), sentencepiece.SentencePieceProcessor(model_proto=unigram)
    assert model.kind == sentence_pieces.UNIGRAM
    own = [*ODD, *((t or "")[:400] for t in TEXTS.values()), "日本語 テキスト", "a" * 40]
    table_ = Dictionary(lambda words: model.encode_words([w.replace(" ", "▁") for w in words]))
    ids, n = model.encode(pa.array(own), table_)
    at = np.concatenate([[0], np.cumsum(n)])
    for k, t in enumerate(own):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t), t


def test_quality_scores(spark, docs, empty):
    rng = random.Random(1)
    common = ["the", "and", "of", "house", "tree", "runs"]
    good = lambda: " ".join(rng.choice(common) for _ in range(60))
    rows = [(1000 + i, good() if i % 2 else good().replace(" ", "%% ").upper(), i % 2) for i in range(400)]
    own = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_model.quality_scores(own, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(held) == sorted(i for i, r in got.items() if r.held_out)
    quality = {i: q for i, _, q in rows}
    assert np.mean([got[i].predicted == quality[i] for i in held]) > 0.95
    out = quality_model.quality_scores(docs, labels)
    scores = out.collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scores)
    assert {r.score for r in quality_model.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.quality_scores(empty, labels).count() == 0


def plain_training(examples, epochs=3, alpha=0.15, beta=1.0, l1=1e-4, l2=1e-3):
    """Follow the regularised leader, a coordinate at a time."""
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else ((l1 if z[i] > 0 else -l1) - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for hashed, label in examples:
            x = {int(i): 16.0 * c / max(1, len(hashed)) for i, c in Counter(hashed.tolist()).items()} | {quality_model.DIM: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_training_and_scores_are_the_plain_ones():
    rng = random.Random(4)
    own = ["", "word", *(" ".join(rng.choice(("the", "of", "Tree", "x9", "%%", "runs")) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    hashed, counts = quality_model.features(pa.array(own))
    ends = np.cumsum(counts)
    examples = [(hashed[e - c : e], k % 2) for k, (e, c) in enumerate(zip(ends, counts))]
    weights, plain = quality_model.train(examples), plain_training(examples)
    assert all(abs(weights[i] - w) < 1e-5 for i, w in plain.items()) and np.count_nonzero(weights) <= len(plain)
    scores = quality_model.scores(pa.array(own), weights)
    for (h, _), score in zip(examples, scores):
        x = sum(plain.get(int(i), 0.0) for i in h) * 16 / max(1, len(h)) + plain[quality_model.DIM]
        assert abs(score - 1 / (1 + np.exp(-x))) < 1e-5


def test_sharding(spark, docs, empty):
    out = virtual_slots.shard_documents(docs, 8, name="docs").toPandas()
    rows = [(i, t or "") for i, t in TEXTS.items()] + [(i, TEXTS[i]) for i in TWICE]
    assert sorted(zip(out.doc_id, out["size"], out.text_crc32)) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows)
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert (out.groupby("vslot").shard.nunique() == 1).all()
    (v1, first), (v2, latest) = virtual_slots.load_map(spark, "docs", 1), virtual_slots.load_map(spark, "docs")
    assert (v1, v2) == (1, 2) and first == virtual_slots.first_map(8)
    assert all(latest[s] == k for s, k in zip(out.vslot, out.shard))
    assert virtual_slots.shard_documents(empty, 8).count() == 0


def test_shards_are_nearly_equal(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, "x" * int(rng.paretovariate(2.5) * 200)) for i in range(6000)], "doc_id long, text string")
    sizes = [r[0] for r in virtual_slots.shard_documents(df, 8).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.001 * max(sizes)


def test_slot_maps(spark):
    rng = random.Random(8)
    sums = [(s, rng.randint(1, 1000), 1) for s in range(0, 512, 2)]
    first = virtual_slots.first_map(7, 512)
    old = virtual_slots.rebalanced_map(first, sums, 7)
    new = virtual_slots.grown_map(old, sums, 9)
    size = lambda m, k: sum(b for s, b, _ in sums if m[s] == k)
    assert max(size(old, k) for k in range(7)) - min(size(old, k) for k in range(7)) <= 2
    assert 0 < sum(a != b for a, b in zip(first, old)) < 100
    assert all(a == b or b >= 7 for a, b in zip(old, new))
    assert max(size(new, k) for k in range(9)) - min(size(new, k) for k in range(9)) < 3000
    for version, m in ((1, first), (2, old), (3, new)):
        virtual_slots.save_map(spark, "t", version, m)
    with pytest.raises(Exception, match="(?i)exist"):
        virtual_slots.save_map(spark, "t", 3, old)
    assert virtual_slots.load_map(spark, "t") == (3, new) and virtual_slots.load_map(spark, "t", 1) == (1, first)
