"""Best-fit packing with certified bounds.

Documents are tokenized where they are read; only (id, piece, length) of their pieces is packed. Pieces are spread
over groups of about GROUP pieces, each packed by best fit decreasing; lower bounds from dual feasible functions
certify a group's number of sequences. A certified group rests: nothing within it can be packed better. The sequences with gaps of the
other groups give their pieces up: these are exchanged between groups and packed again, until their groups are certified
too, or two rounds on end save no sequence. Only if the whole table's bound isn't met then, what is left exchanges once more,
together with the resting groups' sequences with gaps and in larger groups each time (up to WIDEST times GROUP), until one
group is left, the bound is met, or nothing is saved any more. A repacking that needs more sequences than before isn't taken.

Defined results: a null or empty text is one piece, the end mark alone; a document longer than ``capacity`` is
cut into pieces of ``capacity`` tokens after a first one that may be shorter; repeated rows are packed each for
itself; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.store import written
from thicket.llm.textbatch import Dictionary, cuts, per_row, pieces_before_space, ranges, text_column

CAPACITY = 1024
END = 2
GROUP = 50_000
WIDEST = 16
BATCH_BYTES = 4 << 20
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def piece_ids(path: str) -> Dictionary:
    """Remembered ids of pieces of text under a byte-level BPE file, one table for each process.

    Ids of a byte-level BPE vocabulary are in the order of its merges, so the file's ids serve as ranks.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    marks = tuple(special)
    ordinary = own.encode_ordinary

    def encode(texts: list[str]) -> list[list[int]]:
        return [own.encode(t, allowed_special="all") if "<" in t and any(m in t for m in marks) else ordinary(t) for t in texts]

    return Dictionary(encode, 300_000)


def encoded(column: pa.Array, path: str, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of each text's ids); with ``end`` after each text."""
    pieces, counts = pieces_before_space(column)
    ids, at, size = piece_ids(path).look_up(pieces)
    n = per_row(np.add, size, counts)
    flat = ids[ranges(at, size)]
    if end is None:
        return flat, n
    out = np.full(len(flat) + len(n), end, np.int32)
    stay = np.ones(len(out), bool)
    stay[np.cumsum(n + 1) - 1] = False
    out[stay] = flat
    return out, n + 1


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cuts(batch, BATCH_BYTES):
                ids, n = encoded(text_column(part), path, end)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                piece = ranges(np.zeros(len(n), np.int64), count)
                short = n - (count - 1) * capacity
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[doc], capacity)
                at = (np.cumsum(n) - n)[doc] + start
                view = memoryview(ids.astype("<u4")).cast("B")
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())), np.int64, len(at))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset of each piece, filled length of each sequence) by best fit decreasing."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_with: list[list[int]] = [[] for _ in range(capacity + 1)]  # by the room that is left
    rooms, filled = 0, []  # rooms: bit r is set if a sequence with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            k = open_with[room].pop()
            if not open_with[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(filled)
            filled.append(0)
        sequence[i], offset[i] = k, filled[k]
        filled[k] += size
        if room > size:
            open_with[room - size].append(k)
            rooms |= 1 << (room - size)
    return sequence, offset, np.array(filled, np.int64)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs, by dual feasible functions; counts[x]: pieces of length x."""
    x = np.flatnonzero(counts)
    if not len(x):
        return 0
    n = counts[x].astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    for k in range(1, 21):  # u_k: multiples of 1/(k+1) stay, others are rounded to k-ths
        up = (k + 1) * x
        u = np.where(up % capacity == 0, x * k, (up // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((u * n).sum()) // (k * capacity)))
    for small in x[x <= capacity // 2]:  # U_e: what fills more than 1 - e counts as full, what is under e as nothing
        u = np.where(x > capacity - small, capacity, np.where(x < small, 0, x))
        best = max(best, -(-int((u * n).sum()) // capacity))
    return best


def _round(open_pieces: DataFrame, number: int, n_groups: int, capacity: int) -> DataFrame:
    """One round of best fit decreasing by groups: rid, length, sequence_id, offset, full, certified; groups keep an earlier packing of theirs if it isn't worse."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        sequence, offset, filled = best_fit(lengths, capacity)
        certified = len(filled) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        name = sequence + (number << 48 | int(key[0]) << 24)
        was = pdf["sequence_id"].to_numpy()
        if number and len(np.unique(was)) <= len(filled):  # those sequences lie in this group as a whole
            name, offset = was, pdf["offset"].to_numpy()
        own, at = np.unique(name, return_inverse=True)
        room = capacity - np.bincount(at, lengths).astype(np.int64)
        return pd.DataFrame({"rid": pdf["rid"], "length": lengths, "sequence_id": name, "offset": offset, "full": (room == 0)[at], "certified": certified})

    by = "rid" if not number else "sequence_id"  # later, a sequence's pieces stay together
    keyed = open_pieces.withColumn("g", F.pmod(F.xxhash64(by, F.lit(number)), F.lit(n_groups)).cast("int"))
    return keyed.groupBy("g").applyInPandas(pack, "rid long, length long, sequence_id long, offset long, full boolean, certified boolean")


def packed(pieces_: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset."""
    table = written(pieces_.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    sizes = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in sizes.items():
        counts[length] = n
    bound = lower_bound(counts, capacity)
    whole = table.where(F.col("length") == capacity).select("rid", (-F.col("rid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, done, number = int(counts[:capacity].sum()), int(counts[capacity]), 0
    now = table.where(F.col("length") < capacity).select("rid", "length", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    closed, waiting = [], []  # waiting: (sequences with gaps of closed groups, how many pieces, how many sequences)
    fewest, idle, scale, opened = None, 0, 1, None  # opened: the fewest sequences when the resting groups last joined in
    while left:
        n_groups = max(1, left // (group * scale))
        result = written(_round(now, number, n_groups, capacity), f"packing-{number}")
        have = {(r["full"], r["certified"]): (r["n"], r["s"]) for r in result.groupBy("full", "certified").agg(F.count("*").alias("n"), F.countDistinct("sequence_id").alias("s")).collect()}  # at most four rows
        done += sum(s for (full, _), (_, s) in have.items() if full)
        (gaps, open_), (settled, held) = have.get((False, False), (0, 0)), have.get((False, True), (0, 0))
        total = done + open_ + held + sum(s for _, _, s in waiting)
        idle = 0 if fewest is None or total < fewest else idle + 1
        fewest = total if fewest is None else min(total, fewest)
        closed.append(result.where("full"))
        more, alone = idle < 2 and gaps > 0 and n_groups > 1, n_groups == 1 and not waiting
        if settled:
            waiting.append((result.where("not full and certified"), settled, held))
        if gaps and not more:
            waiting.append((result.where("not full and not certified"), gaps, open_))
        number += 1
        columns = ["rid", "length", "sequence_id", "offset"]
        if total > bound and more:
            now, left = result.where("not full and not certified").select(*columns), gaps
        elif total > bound and waiting and not alone and not (scale == WIDEST and fewest == opened):
            opened, idle = fewest, 0
            now, left, scale = functools.reduce(DataFrame.unionByName, (w.select(*columns) for w, _, _ in waiting)), sum(n for _, n, _ in waiting), min(WIDEST, 4 * scale)
            waiting = []
        else:
            if more:
                waiting.append((result.where("not full and not certified"), gaps, open_))
            break
    closed += [w for w, _, _ in waiting]
    places = whole
    for c in closed:
        places = places.unionByName(c.select("rid", "sequence_id", "offset"))
    return table.join(places, "rid").drop("rid")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    return packed(pieces(docs, path, capacity, end), capacity)
