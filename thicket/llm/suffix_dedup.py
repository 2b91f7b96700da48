"""Removal of long repeats with a logarithmic family of sparse suffix arrays.

A batch's suffix array keeps the suffixes that start at anchors (see ``anchors``), sorted by the fingerprint of
their first K bytes and then by that of their whole segment: the bytes of all windows of ``length`` bytes that have this
anchor. Arrays of batches become levels of a family; a new one is merge-scanned against the levels that exist, and
levels of equal size merge, so that an entry is merged a logarithmic number of times. The family is
partitioned by ranges of fingerprints, which spread evenly however often one suffix occurs; a batch holds
an entry once whatever its count, so a suffix that a third of all rows share comes as one entry from each batch.

An anchor whose K bytes occur nowhere else has no repeated window. A segment that occurs again is repeated as a
whole. Segments that only share their first K bytes with others are compared window by window, in the same
way, as a second family. Windows, and segments of equal K bytes, are compared by two independent fingerprints of 64 bits.

The family can be kept (``Index``): a later batch's arrays are scanned against the levels that were written and join them; neither the
earlier batches' texts nor their arrays are made anew, only those of their texts are read again that need a closer look.

Defined results: null texts count as empty, and stay null; texts shorter than ``length`` have no windows and keep everything;
rows repeated with the same id are documents like others (each byte of both goes); extra columns, whatever their names, are
ignored or passed on; an empty table gives no rows. Removal may cut a character in two; ``without_repeats`` drops what is left of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.anchors import CHUNK, K, Fingerprints, anchored
from thicket.llm.components import join_by_text
from thicket.llm.store import dropped, tidied, written
from thicket.llm.textbatch import cuts, mix, ranges, raw, text_column

LENGTH = 200
FLUSH = 1 << 20  #: suffixes of a batch's array, about
BUCKET = 1 << 20  #: entries of a partition of the family, about
MOST_BUCKETS = 1 << 19

_RUN = "batch long, bucket int, keys binary, subs binary, many binary"


class Levels:
    """Sorted arrays of (key, sub, many), merged when equal in size; ``many``: seen twice or more."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, run: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            self.levels.append(self._scan(self.levels.pop(), self.levels.pop()))

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        while len(self.levels) > 1:
            self.levels.append(self._scan(self.levels.pop(), self.levels.pop()))
        return self.levels[0]

    @staticmethod
    def _scan(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, sub, many = (np.concatenate([x, y]) for x, y in zip(a, b))
        order = np.argsort(key, kind="stable")  # two sorted runs: one merge
        key, sub, many = key[order], sub[order], many[order]
        out = np.flatnonzero((key[1:] == key[:-1]) & (sub[1:] < sub[:-1]))
        if len(out):  # equal keys of both runs: their subs have to be put in order
            tied = np.zeros(len(key), bool)
            tied[1:] = key[1:] == key[:-1]
            tied[:-1] |= tied[1:]
            at = np.flatnonzero(tied)
            order = at[np.lexsort((sub[at], key[at]))]
            sub[at], many[at] = sub[order], many[order]
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (sub[1:] == sub[:-1])
        many[:-1] |= same[1:]
        return key[~same], sub[~same], many[~same]


def _scanned(key: tuple, pdf: pd.DataFrame, keep: bool) -> pd.DataFrame:
    """The levels of a bucket's family (batch below 0) after its new runs joined, and for each run, new or not, a code for each entry: 0
    unique, 1 repeated as a whole, 2 shares its key only, 3 as 1, and to be compared with those of code 2 (the first run that has it)."""
    pdf = pdf.sort_values("batch", kind="stable")
    rows = [(np.frombuffer(k, np.uint64), np.frombuffer(s, np.uint64), np.frombuffer(m, np.bool_).copy()) for k, s, m in zip(pdf["keys"], pdf["subs"], pdf["many"])]
    family, is_run = Levels(), pdf["batch"].to_numpy() >= 0
    family.levels = [row for row, run in zip(rows, is_run) if not run][::-1]  # batch -1 is the first and largest
    for row, run, new in zip(rows, is_run, pdf["fresh"].to_numpy()):
        if run and new:
            family.add(row)
    levels = [(-1 - i, key[0], *(x.tobytes() for x in level), None) for i, level in enumerate(family.levels if keep else [])]
    k, s, many = family.whole()
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    lone = np.bincount(group[~many], minlength=len(size)) > 0
    code = np.where(many, np.where(lone[group] & (size[group] > 1), 3, 1), np.where(size[group] > 1, 2, 0)).astype(np.uint8)
    name = mix(k ^ mix(s))
    order = np.argsort(name)
    name, out = name[order], []
    for batch, (rk, rs, _), run in zip(pdf["batch"], rows, is_run):
        if run:
            at = order[np.searchsorted(name, mix(rk ^ mix(rs)))]
            out.append((batch, key[0], None, None, None, code[at].tobytes()))
            code[at[code[at] == 3]] = 1
    return pd.DataFrame(levels + out, columns=["batch", "bucket", "keys", "subs", "many", "codes"])


def _runs(batch: int, n_buckets: int, key: np.ndarray, sub: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
    """A batch's sorted distinct entries, cut into the buckets' ranges of keys."""
    bucket = ((key >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        x = slice(edges[b], edges[b + 1])
        yield batch, int(b), key[x].tobytes(), sub[x].tobytes(), (count[x] > 1).tobytes()


def _distinct(key: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each distinct entry in that order, counts)."""
    order = np.lexsort((sub, key)) if len(sub) else np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if len(sub):
        s = sub[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(k)))


def _union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the half-open spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:] - 1, len(ends) - 1)] if len(starts) else ends


class _Batch:
    """Entries of some rows; flushed as runs of the family and one local record that leads back from entries to rows."""

    def __init__(self, n_buckets: int, ids: pa.DataType):
        self.part, self.number, self.n_buckets, self.id_type = TaskContext.get().partitionId(), 0, n_buckets, ids
        self.clear()

    def clear(self) -> None:
        self.ids, self.hashes, self.n_rows, self.n = [], [], 0, 0
        self.columns: list[list[np.ndarray]] = [[], [], [], [], []]

    def rows(self, ids: pa.Array, hashes: pa.Array) -> int:
        """Add rows; the number of the first."""
        self.ids.append(ids)
        self.hashes.append(hashes)
        self.n_rows += len(ids)
        return self.n_rows - len(ids)

    def entries(self, *columns: np.ndarray) -> None:
        """key, sub, row, first window, last - first; rows and windows in their order."""
        for have, more in zip(self.columns, columns):
            have.append(more)
        self.n += len(columns[0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return self.clear()
        key, sub, row, at, width = (np.concatenate(c) for c in self.columns)
        ids, hashes = pa.concat_arrays(self.ids), pa.concat_arrays(self.hashes)
        batch = self.part << 24 | self.number
        self.number += 1
        self.clear()
        order, first, count = _distinct(key, sub)
        k, s = key[order][first], (sub[order][first] if len(sub) else np.zeros(len(first), np.uint64))
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.repeat(np.arange(len(first), dtype=np.uint32), count)
        used, row = np.unique(row, return_inverse=True)
        # In the rows' order; rows and positions as differences, which compress well.
        local = [x.tobytes() for x in (rank, np.diff(row, prepend=0).astype(np.int32), np.diff(at, prepend=0).astype(np.int32), width.astype(np.uint8))]
        out = [(*x, None, None, None, None) for x in _runs(batch, self.n_buckets, k, s, count)]
        out.append((batch, -1, None, None, None, *local))
        names = ["batch", "bucket", "keys", "subs", "many", "rank", "row", "at", "width"]
        types = [pa.int64(), pa.int32()] + [pa.binary()] * 7
        columns = [pa.array([x[i] for x in out], types[i]) for i in range(9)]
        where = [None] * (len(out) - 1)
        for column in (ids.take(pa.array(used)), hashes.take(pa.array(used))):
            offsets = pa.array([0] * len(out) + [len(used)], pa.int32())
            columns.append(pa.ListArray.from_arrays(offsets, column, mask=pa.array([True] * len(where) + [False])))
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids", "hashes"])


def _schema(kind: str) -> str:
    return f"{_RUN}, rank binary, row binary, at binary, width binary, ids array<{kind}>, hashes array<bigint>"


def _suffixes(n_buckets: int, length: int) -> Callable:
    """Batches of (doc_id, text, text hash) -> their sparse suffix arrays."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or _Batch(n_buckets, batch.column("doc_id").type)
            for part in cuts(batch, CHUNK // 2):
                data, ends = raw(text_column(part))
                base = own.rows(part.column("doc_id"), part.column("th"))
                if len(data) <= CHUNK:
                    pieces = [(data, ends[:-1], ends[1:], 0)]
                else:  # one long text (or few): pieces that overlap by a window less one byte
                    pieces = []
                    for i in range(len(ends) - 1):
                        for a in range(int(ends[i]), max(int(ends[i]) + 1, int(ends[i + 1]) - length + 1), CHUNK - length + 1):
                            text = data[a : min(a + CHUNK, int(ends[i + 1]))]
                            pieces.append((text, np.array([0]), np.array([len(text)]), (i, a - int(ends[i]))))
                for text, starts, stops, place in pieces:
                    f, row, s, e, a = anchored(text, starts, stops, length)
                    if not len(s):
                        continue
                    # Anchors have small fingerprints, so these are scrambled once more to spread over the buckets.
                    sub = mix(f.of(s, e + length) ^ ((a - s) << 20 | (e - s)).astype(np.uint64))
                    at = s - starts[row]
                    if place:
                        row, at = row + place[0], at + place[1]
                    own.entries(mix(~f.of(a, a + K)), sub, row + base, at, e - s)
                if own.n >= FLUSH:
                    yield from own.flush()
        if own:
            yield from own.flush()

    return make


def _windows(n_buckets: int, length: int) -> Callable:
    """Batches of (doc_id, text, text hash, need) -> sorted fingerprints of the windows asked for."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or _Batch(n_buckets, batch.column("doc_id").type)
            for part in cuts(batch, CHUNK // 2):
                base = own.rows(part.column("doc_id"), part.column("th"))
                for i, (text, need) in enumerate(zip(part.column("text").to_pylist(), part.column("need").to_pylist())):
                    data = np.frombuffer(text.encode(), np.uint8)
                    want = np.frombuffer(need, np.uint32).astype(np.int64).reshape(2, -1)
                    s = ranges(want[0], want[1] + 1)
                    for a in range(0, len(data), CHUNK - length + 1):
                        here = s[(s >= a) & (s <= a + CHUNK - length)]
                        if len(here):
                            one, two = (Fingerprints(data[a : a + CHUNK], kind).of(here - a, here - a + length) for kind in (0, 1))
                            zero = np.zeros(len(here), np.int64)
                            own.entries(one, two, zero + base + i, here, zero)
                            s = s[s > a + CHUNK - length]
                        if not len(s):
                            break
                if own.n >= FLUSH:
                    yield from own.flush()
        if own:
            yield from own.flush()

    return make


def _family(runs: DataFrame, index: Index | None, name: str, keep: bool = True) -> DataFrame:
    """Codes of all runs, and to ``keep`` the levels of the family that they make with those of the index; by bucket."""
    fresh = runs.where("bucket >= 0").select("batch", "bucket", "keys", "subs", "many", F.lit(True).alias("fresh"))
    if index is not None:
        old = F.lit(False).alias("fresh")
        levels = index.family.where("batch < 0").select("batch", "bucket", "keys", "subs", "many", old)
        fresh = fresh.unionByName(levels).unionByName(index.runs.where("bucket >= 0").select("batch", "bucket", "keys", "subs", "many", old))
    return written(fresh.groupBy("bucket").applyInPandas(lambda key, pdf: _scanned(key, pdf, keep), f"{_RUN}, codes binary"), name)


def _judged(runs: DataFrame, family: DataFrame, kind: str, length: int, spill: str) -> DataFrame:
    """doc_id, th, full (repeated spans) and need (windows to compare) of the rows that have any."""
    codes = family.where("batch >= 0").select("batch", "bucket", "codes")
    by_batch = codes.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "codes"))).alias("c"))  # a byte for each entry of the batch
    local = runs.where("bucket = -1").select("batch", "rank", "row", "at", "width", "ids", "hashes")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            code = np.frombuffer(b"".join(x["codes"] for x in r.c), np.uint8)
            rank, width = np.frombuffer(r.rank, np.uint32), np.frombuffer(r.width, np.uint8).astype(np.int64)
            row, at = np.cumsum(np.frombuffer(r.row, np.int32)), np.cumsum(np.frombuffer(r.at, np.int32), dtype=np.int64)
            each = code[rank]
            first = np.zeros(len(each), bool)
            shared = np.flatnonzero(each == 3)
            first[shared[np.unique(rank[shared], return_index=True)[1]]] = True
            whole, need = (each & 1) == 1, (each == 2) | first
            order = np.flatnonzero(whole | need)
            rows, edges = np.unique(row[order], return_index=True)
            for i, x in zip(rows, np.split(order, edges[1:])):
                w, n = x[whole[x]], x[need[x]]
                full = np.stack(_union(at[w], at[w] + width[w] + length)).astype(np.uint32) if len(w) else np.zeros(0, np.uint32)
                out.append((r.ids[i], r.hashes[i], full.tobytes(), np.stack([at[n], width[n]]).astype(np.uint32).tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "th", "full", "need"])

    joined = local.join(by_batch, "batch")
    spans = joined.groupBy("batch").applyInPandas(judge, f"doc_id {kind}, th long, full binary, need binary")
    # Repeated rows have equal spans, and at most one of them is asked for windows.
    return written(spans.groupBy("doc_id", "th").agg(F.max("full").alias("full"), F.max("need").alias("need")), spill)


def _buckets(n: float) -> int:
    return int(min(MOST_BUCKETS, max(1, -(-n // BUCKET))))


@dataclass(frozen=True)
class Index:
    """A family that was kept: suffix arrays by batch with what leads back to rows, and by bucket the levels and the arrays' codes."""

    runs: DataFrame
    family: DataFrame
    n_buckets: int
    n_batches: int  # numbers of batches are below

    def dropped(self) -> None:
        dropped(self.runs, self.family)


def added(docs: DataFrame, index: Index | None = None, length: int = LENGTH) -> Index:
    """The index with the suffix arrays of docs; without one, a new index."""
    if not K < length <= K + 255:
        raise ValueError(f"length must be above {K} and at most {K + 255}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    if index is None:
        n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        n_buckets = _buckets(2.2 * n_bytes / (length - K + 2))
    else:
        n_buckets = index.n_buckets
    runs = written(hashed(docs).mapInArrow(_suffixes(n_buckets, length), _schema(kind)), "suffixes")
    if index is not None:
        runs = runs.withColumn("batch", F.col("batch") + index.n_batches)
    tidied(runs)
    family = _family(runs, index, "levels")
    tidied(family)
    every = runs if index is None else index.runs.unionByName(runs)
    top = runs.agg(F.max("batch")).first()[0]
    return Index(every, family, n_buckets, top + 1 if top is not None else index.n_batches if index else 0)


def spans_of(index: Index, docs: DataFrame, length: int = LENGTH, keep: bool = True) -> DataFrame:
    """doc_id, th (hash of the text), full, more: the repeated spans of the index's documents that have any, as binary arrays of uint32 starts, then ends.

    docs: all of these documents. Without ``keep`` the index is deleted as soon as nothing more is read from it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = _judged(index.runs, index.family, kind, length, "spans")
    if not keep:
        index.dropped()
    tidied(spans)
    ask = spans.where("length(need) > 0").select("doc_id", "th", "need")
    n_windows = (ask.agg(F.sum(F.length("need"))).first()[0] or 0) / 8 * (length - K) / 2
    second = written(join_by_text(hashed(docs), ask).mapInArrow(_windows(_buckets(n_windows), length), _schema(kind)), "windows")
    tidied(second)
    family = _family(second, None, "window-codes", keep=False)
    tidied(family)
    more = _judged(second, family, kind, length, "window-spans")
    dropped(second, family)
    tidied(more)
    none = F.lit(None).cast("binary")
    both = spans.select("doc_id", "th", "full", none.alias("more")).unionByName(more.select("doc_id", "th", none.alias("full"), F.col("full").alias("more")))
    return both.groupBy("doc_id", "th").agg(F.max("full").alias("full"), F.max("more").alias("more"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """spans_of an index of docs alone, which isn't kept."""
    return spans_of(added(docs, None, length), docs, length, keep=False)


def hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))


def _removed(data: np.ndarray, *spans: bytes | None) -> tuple[np.ndarray, int]:
    """(True for bytes that stay, number of maximal removed runs)."""
    pairs = [np.frombuffer(s, np.uint32).astype(np.int64).reshape(2, -1) for s in spans if s]
    keep = np.ones(len(data), bool)
    if not pairs:
        return keep, 0
    starts, ends = _union(*np.concatenate(pairs, axis=1))
    for a, b in zip(starts, ends):
        keep[a:b] = False
    return keep, len(starts)


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    return join_by_text(hashed(docs), repeated_spans(docs, length), "left")


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = raw(text_column(batch))
            out = []
            for i, (full, more) in enumerate(zip(batch.column("full").to_pylist(), batch.column("more").to_pylist())):
                text = data[ends[i] : ends[i + 1]]
                keep, n = _removed(text, full, more)
                kept = text[keep] if n else text
                out.append((len(text), len(text) - len(kept), n, hashlib.sha256(kept.tobytes()).hexdigest()))
            columns = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs, length).select("doc_id", "text", "full", "more").mapInArrow(digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The input's columns, ``text`` without its repeats; rows whose whole text goes are dropped, null and empty texts stay.

    ``n_chars``, where there is such a column, is counted anew in rows that lose something.
    """
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]  # names that can't clash
    at, counted = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stays, sizes = batch.column(own[at]).to_pylist(), [], {}
            for i, (full, more) in enumerate(zip(batch.column("full").to_pylist(), batch.column("more").to_pylist())):
                if full or more:
                    data = np.frombuffer(texts[i].encode(), np.uint8)
                    texts[i] = data[_removed(data, full, more)[0]].tobytes().decode(errors="ignore")
                    sizes[i] = len(texts[i])
                stays.append(i not in sizes or sizes[i] > 0)
            columns = [batch.column(c) for c in own]
            columns[at] = pa.array(texts, pa.string())
            if counted >= 0 and sizes:
                old = columns[counted]
                columns[counted] = pa.array([sizes.get(i, x) for i, x in enumerate(old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=own).filter(pa.array(stays, pa.bool_()))

    renamed = docs.toDF(*own)
    keyed = renamed.select("*", F.col(own[names.index("doc_id")]).alias("doc_id"), F.xxhash64(F.coalesce(own[at], F.lit(""))).alias("th"))
    met = join_by_text(keyed, repeated_spans(docs.select("doc_id", "text"), length), "left").select(*own, "full", "more")
    return met.mapInArrow(cut, renamed.schema).toDF(*names)
