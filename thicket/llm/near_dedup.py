"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle set keeps both its minimum and its maximum, each of which agrees between two sets
with their Jaccard similarity as the probability, so half the hash evaluations give as many values. Bands of ROWS
values name buckets. Documents with equal sets are one node. Of the nodes that share buckets links are confirmed on full sets
without writing all pairs (see ``linked``), in buckets of any size.

A link that shares no band is missed: (1 - 0.8 ** ROWS) ** BANDS = 3e-6 of those with similarity 0.8, fewer above.

Defined results: texts without a word (null, empty, white space) have an empty set and are linked with nothing; a text
of one word has that word as its only shingle; rows repeated with one id are alike; extra columns are ignored; an empty table
gives no rows. Shingles are compared by 52-bit hashes of their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.components import join_back
from thicket.llm.linked import Linked, Refuted, Say, linked_groups
from thicket.llm.store import dropped, tidied, written
from thicket.llm.textbatch import cuts, mix, per_row, text_column, word_hashes, words_of

ROWS, BANDS = 4, 24
BATCH_BYTES = 4 << 20
_BITS = np.uint64(52)
_LOW = (np.uint64(1) << _BITS) - np.uint64(1)


def shingles(column: pa.Array, size: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 52-bit shingles of each text, counts). At most 4096 texts at a time."""
    words, counts = words_of(pc.ascii_lower(column))
    w = word_hashes(words)
    n = len(w)
    x = w.copy()
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(n)
    for k in range(1, size):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([w[k:], np.zeros(min(k, n), np.uint64)]))
    # Of a text with fewer words than a shingle, the whole sequence is the only one.
    valid = at + size <= ends
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    starts = np.cumsum(counts) - counts
    for k in range(1, size):
        a = starts[counts == k]
        v = np.full(len(a), k, np.uint64)
        for i in range(k):
            v = mix(v * np.uint64(0xC2B2AE3D27D4EB4F) + w[a + i])
        x[a], valid[a] = v, True
    key = np.sort(doc[valid] << _BITS | (x[valid] & _LOW))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & _LOW, np.bincount((key >> _BITS).astype(np.int64), minlength=len(counts))


def permutations(n: int) -> np.ndarray:
    """n rows (mask, odd factor) of 64 bits."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(n, 2)
    x[:, 1] |= np.uint64(1)
    return x


def signatures(x: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The minima and maxima under n permutations of each set: an array of len(counts) rows and 2 n columns."""
    out = np.zeros((len(counts), 2 * n), np.uint64)
    for j, (mask, factor) in enumerate(permutations(n)):
        t = (x ^ mask) * factor
        out[:, 2 * j] = per_row(np.minimum, t, counts)
        out[:, 2 * j + 1] = per_row(np.maximum, t, counts)
    return out


def _nodes(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """16 bytes for each set that name it."""
    out = np.zeros((len(counts), 2), np.uint64)
    out[:, 0] = mix(per_row(np.add, mix(x), counts) + counts.astype(np.uint64))
    out[:, 1] = mix(per_row(np.add, mix(x ^ np.uint64(0x5851F42D4C957F2D)), counts))
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in cuts(batch, BATCH_BYTES):
            for k in range(0, part.num_rows, 4096):
                yield part.slice(k, 4096)


def sketches(docs: DataFrame, size: int = 2, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, node and bucket names of every row; no buckets for an empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            x, counts = shingles(text_column(part), size)
            values = signatures(x, counts, -(-rows * bands // 2))[:, : rows * bands].reshape(len(counts), bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(counts), bands))
            for r in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
            some = counts > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            buckets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[some].ravel().view(np.int64)))
            names = pa.Array.from_buffers(pa.binary(16), len(counts), [None, pa.py_buffer(_nodes(x, counts).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts.astype(np.int64)), names, buckets], names=["doc_id", "n_shingles", "node", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sketch, f"doc_id {kind}, n_shingles long, node binary, buckets array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, content (its shingles) and sketch of the wanted nodes, from the row that stands for each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            x, counts = shingles(text_column(part), size)
            names = _nodes(x, counts)
            at = np.cumsum(counts) - counts
            rows = [(i, x[a : a + c].tobytes()) for i, (a, c, node) in enumerate(zip(at, counts, part.column("node").to_pylist())) if names[i].tobytes() == node]
            take = pa.array([i for i, _ in rows], pa.int64())
            sketch = [parities(np.frombuffer(s, np.uint64)) for _, s in rows]
            yield pa.RecordBatch.from_arrays([part.column("node").take(take), pa.array([s for _, s in rows], pa.binary()), pa.array(sketch, pa.binary())], names=["node", "content", "sketch"])

    keyed = docs.select("doc_id", "text").join(wanted.select(F.col("rep").alias("doc_id"), "node"), "doc_id")
    # Several rows may have the id of the row that stands for a node.
    return keyed.mapInArrow(make, "node binary, content binary, sketch binary")


def parities(x: np.ndarray) -> bytes:
    """A set's size, and for bins of its hashes (four to eight for each, a power of two) whether they hold an odd number of them."""
    n = 1 << max(8, (4 * len(x) - 1).bit_length())
    odd = np.bincount((x & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.uint64(len(x)).tobytes() + np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _refuted(percent: int) -> Refuted:
    """Bins of different parity are no more than the hashes that only one of two sets has: too many of them refute a link for certain."""

    def refuted(a: list[bytes], b: list[bytes]) -> np.ndarray:
        out = np.zeros((len(a), len(b)), bool)
        sides = []
        for side in (a, b):
            by: dict[int, list[int]] = {}
            for k, t in enumerate(side):
                by.setdefault(len(t), []).append(k)
            sides.append([(np.array(at), np.frombuffer(b"".join(side[k] for k in at), np.uint64).reshape(len(at), -1)) for at in by.values()])
        for at, x in sides[0]:
            for to, y in sides[1]:
                p, q = x[:, 1:], y[:, 1:]
                while p.shape[1] > q.shape[1]:
                    p = p[:, : p.shape[1] // 2] ^ p[:, p.shape[1] // 2 :]
                while q.shape[1] > p.shape[1]:
                    q = q[:, : q.shape[1] // 2] ^ q[:, q.shape[1] // 2 :]
                n = y[:, 0].astype(np.int64)
                for k, own in enumerate(p):
                    apart = np.bitwise_count(q ^ own).sum(axis=1, dtype=np.int64)
                    out[at[k], to] = apart * (100 + percent) > (100 - percent) * (n + int(x[k, 0]))
        return out

    return refuted


def _linked(percent: int) -> Linked:
    def linked(a: list[bytes], b: list[bytes]) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for i, (p, q) in enumerate(zip(a, b)):
            x, y = (np.frombuffer(t, np.uint64) for t in ((p, q) if len(p) <= len(q) else (q, p)))
            if 100 * len(x) < percent * len(y):
                continue
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            out[i] = 100 * common >= percent * (len(x) + len(y) - common)
        return out

    return linked


def _shared(nodes: DataFrame, percent: int) -> DataFrame:
    """bucket, node, leader, more (there are more than two) of the buckets that hold several nodes of nearly equal size.

    Linked sets' sizes differ by a factor of 100 / percent at most; so buckets are cut into windows of sizes, each node in two of
    them, and two such nodes have a window in common.
    """
    members = nodes.select("node", "n_shingles", F.explode("buckets").alias("bucket"))
    several = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = join_back(members, several, "bucket")
    width = 2 * math.log(100 / percent) + 1e-6
    x = F.log(F.col("n_shingles").cast("double")) / F.lit(width)
    windows = F.array(F.xxhash64("bucket", 2 * F.floor(x)), F.xxhash64("bucket", 2 * F.floor(x + 0.5) + 1))
    cut = written(members.select("node", F.explode(windows).alias("bucket")), "members")
    groups = cut.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    out = written(join_back(cut, groups, "bucket").select("bucket", "node", "leader", (F.col("n") > 2).alias("more")), "members")
    dropped(cut)
    return out


def _key(docs: DataFrame) -> Column:
    """A key for rows: the id, or where it is null, after all ids, the text's hash."""
    none, kind = F.col("doc_id").isNull(), docs.schema["doc_id"].dataType
    blank = F.lit("0").cast(kind)
    return F.struct(none.alias("none"), F.coalesce("doc_id", blank).alias("id"), F.when(none, F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0).cast("long")).alias("th"))


def near_groups(docs: DataFrame, percent: int = 80, size: int = 2, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    if not docs.where("doc_id is null").take(1):
        return _groups(docs, percent, size, rows, bands)
    own = lambda c: F.when(~F.col(c)["none"], F.col(c)["id"]).alias(c)
    return _groups(docs.withColumn("doc_id", _key(docs)), percent, size, rows, bands).select(own("doc_id"), "n_shingles", own("component_id"), "kept")


def _groups(docs: DataFrame, percent: int = 80, size: int = 2, rows: int = ROWS, bands: int = BANDS, say: Say | None = None) -> DataFrame:
    table = written(sketches(docs, size, rows, bands), "sketches")
    kind = docs.schema["doc_id"].dataType.simpleString()
    nodes = written(
        table.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("buckets").alias("buckets"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n")), "nodes"
    )
    members = _shared(nodes, percent)
    tidied(members)
    if say:
        say(f"rows {table.count()}, nodes {nodes.count()}, members {members.count()}")
    wanted = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    sets = written(_sets(docs, wanted, size).dropDuplicates(["node"]), "sets")
    tidied(sets)
    labels = linked_groups(members, sets, _linked(percent), say, _refuted(percent))
    dropped(sets, members)
    own = nodes.select("node", "rep", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = own.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    by_node = written(join_back(own.select("node", "label", F.col("n").alias("copies")), least, "label").select("node", "component_id", F.col("copies").alias("n")), "components")
    filled = join_back(table.where("n_shingles > 0").select("doc_id", "n_shingles", "node"), by_node, "node").select("doc_id", "n_shingles", "component_id")
    empty = table.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").cast(kind).alias("component_id"))
    return filled.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of docs, of each group of near duplicates the one with the smallest doc_id; texts without words stay."""
    if not docs.where("doc_id is null").take(1):
        return docs.join(_groups(docs, **options).where("kept").select("doc_id").distinct(), "doc_id", "left_semi")
    kept = _groups(docs.select(_key(docs).alias("doc_id"), "text"), **options).where("kept").select(F.col("doc_id").alias("kept_key")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("own_row"), _key(docs).alias("row_key"))
    return rows.join(kept, F.col("row_key") == F.col("kept_key"), "left_semi").select("own_row.*")
