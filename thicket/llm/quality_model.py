"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

Features of a whole text: its words, pairs of neighbouring words, and 1- to 3-grams of word shapes (letters as a
or A, digits as 0, other signs as they are; a word that repeats its predecessor has a shape of its own), each
hashed into one of DIM weights. A score is the sigmoid of a sparse dot product. Training uses a bounded sample of
labelled rows: those with the smallest hashes of their ids, at most ``most`` (default MOST), whatever the corpus;
scoring reads every row. Labels, language, source and id are no inputs of a score.

Defined results: a null or empty text has the score of the intercept alone; without labelled rows every score is
0.5; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.store import written
from thicket.llm.textbatch import cuts, mix, per_row, text_column, words_of

BITS = 18
DIM = 1 << BITS
MOST = 8000
BATCH_BYTES = 4 << 20
SCALE = np.float32(16)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of all texts, how many each has)."""
    from pandas.util import hash_array

    words, counts = words_of(column)
    if not len(words):
        return np.zeros(0, np.int64), counts
    coded = words.dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64)
    shapes = coded.dictionary
    for pattern, sign in ((r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "a"), (r"[\p{Lu}\p{Lt}]+", "A"), (r"\p{N}+", "0")):
        shapes = pc.replace_substring_regex(shapes, pattern, sign)
    kinds = shapes.dictionary_encode()
    kind_hash = hash_array(kinds.dictionary.to_numpy(zero_copy_only=False), categorize=False)[kinds.indices.to_numpy()]
    w = hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[number]
    s = kind_hash[number]
    ends = np.cumsum(counts)
    first = np.zeros(len(w), bool)
    first[(ends - counts)[counts > 0]] = True
    again = np.zeros(len(w), bool)
    again[1:] = (number[1:] == number[:-1]) & ~first[1:]
    s = np.where(again, s ^ np.uint64(0x5BD1E995), s)
    before = lambda x, at, k: np.concatenate([np.full(k, 7, np.uint64), x[:-k]]) * ~at + at * np.uint64(7)
    second = first | np.concatenate([[False], first[:-1]])
    one, two = before(s, first, 1), before(s, second, 2)
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    grams = np.stack([w, before(w, first, 1) * a + w, s * b, one * a + s * b, two * c + one * a + s * b], axis=1)
    return (mix(grams.ravel()) >> np.uint64(64 - BITS)).astype(np.int64), counts * grams.shape[1]


def train(examples: list[tuple[np.ndarray, int]], epochs: int = 3, alpha: float = 0.15, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> np.ndarray:
    """Weights by FTRL-proximal updates, one example after the other; the last weight is the intercept.

    An example: (hashed features with repeats, label).
    """
    z, n, w = (np.zeros(DIM + 1) for _ in range(3))
    sparse = []
    for hashed, label in examples:
        at, count = np.unique(hashed, return_counts=True)
        sparse.append((np.append(at, DIM), np.append(float(SCALE) * count / max(1, len(hashed)), 1.0), label))
    for _ in range(epochs):
        for at, x, label in sparse:
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            w[at] = wi
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - label) * x
            more = np.sqrt(ni + g * g) - np.sqrt(ni)
            z[at] = zi + g - more / alpha * wi
            n[at] = ni + g * g
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)


def scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    hashed, counts = features(column)
    sums = per_row(np.add, weights[hashed], counts) * SCALE / np.maximum(counts, 1)
    return 1 / (1 + np.exp(-np.clip(sums.astype(np.float64) + float(weights[DIM]), -35, 35)))


def fit(docs: DataFrame, labelled: DataFrame, most: int = MOST) -> np.ndarray:
    """Weights learned from labelled (doc_id, label): at most ``most`` rows of it, those with the smallest hashes of ids."""
    sample = labelled.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = F.broadcast(sample.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most))  # at most ``most`` rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cuts(batch, BATCH_BYTES):
                hashed, counts = features(text_column(part))
                ends = np.cumsum(counts)
                blobs = [hashed[e - c : e].astype(np.uint32).tobytes() for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("label"), pa.array(blobs, pa.binary())], names=["doc_id", "label", "hashed"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(order=pd.util.hash_array(pdf["doc_id"].to_numpy(dtype=object), categorize=False)).sort_values(["order", "doc_id"], kind="stable").drop_duplicates("doc_id")
        w = train([(np.frombuffer(b, np.uint32).astype(np.int64), int(y)) for b, y in zip(pdf["hashed"], pdf["label"])])
        return pd.DataFrame({"weights": [w.tobytes()]})

    examples = docs.select("doc_id", "text").join(sample, "doc_id").mapInArrow(extract, "doc_id string, label int, hashed binary")
    got = examples.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(learn, "weights binary").collect()  # one row of 4 * (DIM + 1) bytes
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros(DIM + 1, np.float32)


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 * (DIM + 1) bytes

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cuts(batch, BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(text_column(part), shared.value))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learned only from labelled rows that aren't held out."""
    weights = fit(docs, labels.where(~held_out()).select("doc_id", F.col("quality").alias("label")), most)
    return scored(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
