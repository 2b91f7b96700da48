"""Vectorised handling of Arrow text columns, shared by the operators of this subpackage.

Everything here works on whole texts: a batch is cut between documents, and only a document larger than a
cut is handed on alone. Words are runs of bytes other than 0x20 and 0x09-0x0D, so that UTF-8 texts can be
split without decoding them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: True for the six ASCII white-space bytes.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as a string array without nulls (null: empty text)."""
    column = batch.column(name)
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array: row i is bytes[offsets[i]:offsets[i + 1]], from 0 on."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def cuts(batch: pa.RecordBatch, n_bytes: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about n_bytes of text each; a longer row is a slice of its own."""
    if not batch.num_rows:
        return
    column = batch.column(name)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + n_bytes, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def balanced(batches: Iterator[pa.RecordBatch], n_bytes: int, name: str = "text", most_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batches' rows, cut and joined into batches of about n_bytes of text; a longer row is a batch of its own."""
    have: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        for part in cuts(batch, n_bytes, name):
            n = pc.sum(pc.binary_length(part.column(name))).as_py() or 0
            if have and (size + n > n_bytes or rows + part.num_rows > most_rows):
                yield pa.concat_batches(have)
                have, size, rows = [], 0, 0
            have.append(part)
            size, rows = size + n, rows + part.num_rows
    if have:
        yield pa.concat_batches(have)


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, counts): all words in order, and how many each row has."""
    split = pc.ascii_split_whitespace(column)
    words = split.flatten()
    counts = np.diff(np.frombuffer(split.buffers()[1], np.int32, len(split) + 1, split.offset * 4)).astype(np.int64)
    full = pc.not_equal(words, "")
    if not pc.all(full, min_count=0).as_py():  # white space at either end leaves empty strings
        keep = full.to_numpy(zero_copy_only=False)
        counts = per_row(np.add, keep.astype(np.int64), counts)
        words = words.filter(full)
    return words, counts


def per_row(ufunc: np.ufunc, values: np.ndarray, counts: np.ndarray, empty=0) -> np.ndarray:
    """ufunc reduced over each row's values; rows without values get ``empty``."""
    out = np.full(len(counts), empty, values.dtype)
    some = counts > 0
    if some.any():
        starts = np.cumsum(counts) - counts
        out[some] = ufunc.reduceat(values, starts[some])
    return out


def pieces_before_space(column: pa.Array, space_table: np.ndarray = SPACE) -> tuple[pa.Array, np.ndarray]:
    """Each text cut before white space: runs of white space with the word that follows; (pieces, counts).

    A cut comes before the first of a run of white space (bytes of space_table) if what precedes it is a character that is neither
    white space of any kind nor an ASCII control character.
    Tokenizers that split words at white space have a boundary there whatever surrounds it.
    """
    data, ends = raw(column)
    n = len(data)
    if not n:
        return pa.array([], pa.string()), np.zeros(len(column), np.int64)
    space = space_table[data]
    start = np.zeros(n + 1, bool)
    before = data[:-1]
    plain = (before > 0x20) & (before < 0x7F)
    first = space[1:] & ~space[:-1]
    start[1:n] = first & plain
    other = np.flatnonzero(first & (before >= 0x80)) + 1
    if len(other):
        c, b, a = data[other - 1], data[other - 2], data[np.maximum(other - 3, 0)]
        blank = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E))
        blank |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8D) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        start[other[~blank]] = True
    start[ends[:-1]] = True
    start[n] = False
    at = np.flatnonzero(start[:n])
    offsets = np.append(at, n).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces, np.searchsorted(at, ends[1:]) - np.searchsorted(at, ends[:-1])


class Dictionary:
    """What ``encode`` (list of distinct strings -> list of int sequences) gives, remembered for up to ``most`` strings of at most KEPT characters.

    Values lie in one growing array; a batch's longer strings, and those beyond the bound, are encoded but not kept.
    """

    KEPT = 48

    def __init__(self, encode: Callable[[list[str]], list], most: int = 400_000):
        self.encode, self.most = encode, most
        self.number: dict[str, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 16, np.int32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _room(self, name: str, n: int) -> None:
        have = getattr(self, name)
        if len(have) < n:
            bigger = np.zeros(max(n, 2 * len(have)), have.dtype)
            bigger[: len(have)] = have
            setattr(self, name, bigger)

    def look_up(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes): string i has ids[starts[i]:starts[i] + sizes[i]]."""
        coded = strings.dictionary_encode()
        names = coded.dictionary.to_pylist()
        found = list(map(self.number.get, names))
        missing = [i for i, x in enumerate(found) if x is None]
        missing.sort(key=lambda i: len(names[i]) > self.KEPT)
        n_short = sum(len(names[i]) <= self.KEPT for i in missing)
        count, base = len(self.number), self.n_ids
        if missing:
            values = self.encode([names[i] for i in missing])
            sizes = np.fromiter(map(len, values), np.int32, len(values))
            flat = np.fromiter(chain.from_iterable(values), np.int32, int(sizes.sum()))
            self._room("ids", base + len(flat))
            self.ids[base : base + len(flat)] = flat
            self._room("at", count + len(missing))
            self._room("size", count + len(missing))
            self.at[count : count + len(missing)] = base + np.cumsum(sizes) - sizes
            self.size[count : count + len(missing)] = sizes
            for k, i in enumerate(missing):
                found[i] = count + k
            kept = max(0, min(n_short, self.most - count))
            for k in range(kept):
                self.number[names[missing[k]]] = count + k
            self.n_ids = base + int(sizes[:kept].sum())
        number = np.asarray(found, np.int64)[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
        return self.ids, self.at[number], self.size[number].astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + sizes[i] - 1 for each i, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, the first one lowest; zeros follow the last."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty((-(-n // 8), 8), np.uint64)
    for k in range(8):
        out[:, k] = padded[k : k + 8 * len(out)].view("<u8")
    return out.ravel()[:n]


def word_hashes(words: pa.Array, places: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word, of its bytes and their number; places: ``eights`` of all bytes, if they are there."""
    data, ends = raw(words)
    starts, left = ends[:-1].copy(), np.diff(ends)
    out = left.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    if not len(data):
        return mix(out)
    parts, on, x = eights(data) if places is None else places, np.flatnonzero(left > 0), out[left > 0]
    starts, left = starts[on], left[on]
    while len(on):
        last = left < 8
        part = parts[starts] & np.where(last, (np.uint64(1) << (8 * (left & 7)).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
        x = mix((x ^ part) * np.uint64(0x9E3779B97F4A7C15))
        out[on] = x
        more = left > 8
        on, x, starts, left = on[more], x[more], starts[more] + 8, left[more] - 8
    return out
