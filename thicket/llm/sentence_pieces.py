"""SentencePiece encoding and decoding in numpy.

Texts are cut where no piece can cross, so that a batch is a set of distinct words. Words of equal length advance
together: fingerprints of all their substrings are differences of prefix sums, which probe the sorted fingerprints of
the pieces; each end position takes the best start by a vectorised maximum and stores it as its backpointer (Viterbi).
For a unigram file a path's score is the sum of its pieces' scores. For a BPE file, whose library merges greedily, a step has no
score but may be forbidden: a piece may follow another only if merging their texts would leave just these two. A text's
merged pieces are the one path whose neighbours all may follow each other, so the maximum finds the library's ids.

Defined results: null and empty texts have no ids; a character without a piece becomes its UTF-8 bytes' pieces, or
the unknown piece if the file has none; repeated rows get equal ids; extra columns are ignored. Only files with the
identity normaliser are read; decoding gives back the text exactly unless ids hold the unknown piece.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from thicket.llm.textbatch import Dictionary, cuts, mix, per_row, pieces_before_space, ranges, raw, text_column

BATCH_BYTES = 4 << 20
LONG = 64  #: characters of a word beyond which it is cut where no piece crosses
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARKS = np.uint64(43)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message in protocol-buffer wire format."""
    i = 0

    def number() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = data[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[i : i + n]
            i += n


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _marked(prints: np.ndarray) -> np.ndarray:
    """For the highest bits of fingerprints whether any of ``prints`` starts so."""
    out = np.zeros(1 << 64 - int(_MARKS), bool)
    out[prints >> _MARKS] = True
    return out


class Prefixes:
    """Fingerprints of the substrings of equally long words: rows of character codes."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _powers(codes.shape[1] + 1)
        self.sums = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:-1], axis=1, out=self.sums[:, 1:])

    def of(self, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[rows, ends] - self.sums[rows, starts]) * self.down[starts])


def codes_of(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


class Model:
    """Pieces of a .model file, or of its bytes."""

    def __init__(self, data: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only files with the identity normaliser that keep white space are supported")
        if any(kind == USER for _, _, kind in pieces):
            raise ValueError("files with user-defined pieces are not supported")
        self.kind, self.dummy_prefix = trainer.get(3, UNIGRAM), bool(normalizer.get(3, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE files are supported")
        self.pieces = [p for p, _, _ in pieces]
        normal = [i for i, (_, _, kind) in enumerate(pieces) if kind == NORMAL]
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte = np.array([byte[b] for b in range(256)], np.int64) if len(byte) == 256 else None
        names: dict[str, int] = {}
        for i in normal:
            names.setdefault(self.pieces[i], i)
        self.longest = max(map(len, names))
        keys = np.concatenate([Prefixes(codes_of(of_length, n)).of(np.arange(len(of_length)), np.zeros(len(of_length), int), np.full(len(of_length), n)) for n in range(1, self.longest + 1) if (of_length := [p for p in names if len(p) == n])])
        ids = np.array([names[p] for n in range(1, self.longest + 1) for p in names if len(p) == n], np.int64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.may = _marked(self.keys)
        self.scores = np.array([s for _, s, _ in pieces], np.float32)[self.ids]
        if self.kind == BPE:
            self._merges(names, {p: pieces[i][1] for p, i in names.items()})
        self.neighbours = np.unique(np.array([ord(x) << 21 | ord(y) for p in names for x, y in zip(p, p[1:])] or [-1], np.int64))
        self.unknown_score = np.float32(min(pieces[i][1] for i in normal) - 10)
        #: White space before which no piece crosses.
        self.cut = np.zeros(256, bool)
        for c in " \t\n\x0b\x0c":
            own = MARK if c == " " else c
            self.cut[ord(c)] = not any(own in (p.lstrip(own) if c == " " else p[1:]) for p in names)
        text = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.text_size = np.array([len(t) for t in text], np.int64)
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.text = np.frombuffer(b"".join(text), np.uint8)

    def probe(self, prints: np.ndarray) -> np.ndarray:
        """Place of each fingerprint among the sorted keys, or -1."""
        out = np.full(prints.shape, -1, np.int64)
        some = np.nonzero(self.may[prints >> _MARKS])  # few substrings are pieces
        own = prints[some]
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == own, at, -1)
        return out

    def _merges(self, names: dict[str, int], scores: dict[str, float]) -> None:
        """Tables of a BPE file: for each piece, numbered in the order in which merges take it, the two that it is merged from.

        Single characters come first and are whole; pieces that merging never makes are left out.
        """
        single = [p for p in names if len(p) == 1]
        order = single + sorted((p for p in names if len(p) > 1), key=lambda p: -scores[p])
        number = {p: i for i, p in enumerate(order)}
        left, right = list(range(len(order))), list(range(len(order)))
        whole, pairs = [True] * len(single) + [False] * (len(order) - len(single)), {}

        def apart(a: int, b: int) -> bool:
            limit = len(order) + 1
            while True:
                if pairs.get((a, b), limit) < limit:
                    return False
                if a > b:
                    limit, a = a, right[a]
                    if a == limit:
                        limit, b = b + 1, left[b]
                        if b + 1 == limit:
                            return True
                else:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        limit, a = a, right[a]
                        if a == limit:
                            return True

        for i in range(len(single), len(order)):
            p = order[i]
            for k in range(len(p) - 1, 0, -1):
                a, b = number.get(p[:k], i), number.get(p[k:], i)
                if a < i and b < i and whole[a] and whole[b] and apart(a, b):
                    pairs[a, b], left[i], right[i], whole[i] = i, a, b, True
                    break
        at = np.array([number[self.pieces[i]] for i in self.ids.tolist()], np.int64)  # of the sorted keys
        self.number, self.whole = at, np.array(whole)[at]
        self.left, self.right = np.array(left), np.array(right)
        keys = np.array([a * len(order) + b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.pair_keys, self.pair_values = keys[by], np.array(list(pairs.values()), np.int64)[by]
        self.pair_may = _marked(self.pair_keys.astype(np.uint64) * _BASE)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a: undoing merges from both sides of the border finds none across it that came earlier."""
        out, n = np.ones(len(a), bool), len(self.left)
        if not len(self.pair_keys):
            return out
        on, limit = np.arange(len(a)), np.full(len(a), n + 1)
        while len(on):
            key = a * n + b
            some = np.flatnonzero(self.pair_may[key.astype(np.uint64) * _BASE >> _MARKS])
            at = np.minimum(np.searchsorted(self.pair_keys, key[some]), len(self.pair_keys) - 1)
            joined = np.zeros(len(on), bool)
            joined[some] = (self.pair_keys[at] == key[some]) & (self.pair_values[at] < limit[some])
            out[on[joined]] = False
            # The later merge of both sides is undone; if its piece is a character, that of the other side.
            first = a > b
            a_whole, b_whole = self.right[a] == a, self.left[b] == b
            undo_a = np.where(first, ~a_whole, b_whole & ~a_whole)
            undo_b = np.where(first, a_whole & ~b_whole, ~b_whole)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            go = ~joined & (undo_a | undo_b)
            on, a, b, limit = on[go], a[go], b[go], limit[go]
        return out

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ids), -1 where no piece ends: the last piece of the best path to each end position."""
        n, length = codes.shape
        prints, rows = Prefixes(codes), np.arange(n)[:, None]
        best = np.full((n, length + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back, piece = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), self.unknown, np.int32)
        last = np.full((n, length + 1), -1, np.int32) if self.kind == BPE else None
        for e in range(1, length + 1):
            s = np.arange(max(0, e - self.longest), e)
            at = self.probe(prints.of(rows, s[None, :], np.array([[e]])))
            if last is None:
                score = np.where(at >= 0, self.scores[at], np.float32(-np.inf))
            else:
                can = (at >= 0) & self.whole[at]
                before = last[:, s]
                i, j = np.nonzero(can & (before >= 0))
                can[i, j] = self._apart(before[i, j].astype(np.int64), self.number[at[i, j]])
                score = np.where(can, np.float32(0), np.float32(-np.inf))
            single = at[:, -1] < 0
            score[single, -1] = self.unknown_score if last is None else 0
            total = best[:, s] + score
            k = np.argmax(total, axis=1)  # the first of equal ones
            best[:, e] = total[rows[:, 0], k]
            back[:, e] = s[k]
            found = at[rows[:, 0], k]
            piece[:, e] = np.where(found >= 0, self.ids[found], self.unknown)
            if last is not None:
                last[:, e] = np.where(found >= 0, self.number[found], -1)
        return back, piece

    def _paths(self, codes: np.ndarray, words: list[str]) -> list[list[int]]:
        """Per word its ids by the best path."""
        back, piece = self.viterbi(codes)
        n, length = codes.shape
        edge, rows, at = np.zeros((n, length + 1), bool), np.arange(n), np.full(n, length)
        while len(rows):
            edge[rows, at] = True
            at = back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        ids, ends = piece[edge], np.cumsum(edge.sum(axis=1))
        flat, ends = ids.tolist(), ends.tolist()
        out = [flat[i:j] for i, j in zip([0, *ends], ends)]
        for k in np.flatnonzero(((piece == self.unknown) & edge).any(axis=1)).tolist():
            out[k] = self._known(words[k], [0, *np.flatnonzero(edge[k]).tolist()], out[k])
        return out

    def _parts(self, word: str) -> list[str]:
        """A long word cut between characters that are neighbours in no piece."""
        if len(word) <= LONG or (self.kind == UNIGRAM and self.byte is None):  # there, unknown neighbours are one piece
            return [word]
        codes = codes_of([word], len(word))[0].astype(np.int64)
        key = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.neighbours, key), len(self.neighbours) - 1)
        edges = [0, *(np.flatnonzero(self.neighbours[at] != key) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(edges, edges[1:])]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words in which spaces already are marks."""
        parts = [self._parts(w) for w in words]
        flat = [p for own in parts for p in own]
        found: dict[str, list[int]] = dict.fromkeys(flat)
        by_length: dict[int, list[str]] = {}
        for p in found:
            by_length.setdefault(len(p), []).append(p)
        for length, own in by_length.items():
            step = max(1, (1 << 18) // max(1, length))
            for k in range(0, len(own) if length else 0, step):
                part = own[k : k + step]
                found.update(zip(part, self._paths(codes_of(part, length), part)))
        return [found[own[0]] or [] if len(own) == 1 else [i for p in own for i in found[p]] for own in parts]

    def _known(self, word: str, edges: list[int], found: list[int]) -> list[int]:
        """The ids found between the edges, unknown ones replaced by those of their bytes where the file has these."""
        if self.unknown not in found:
            return found
        ids: list[int] = []
        for a, b, p in zip(edges, edges[1:], found):
            if p != self.unknown:
                ids.append(p)
            elif self.byte is not None:
                ids += self.byte[list(word[a:b].encode())].tolist()
            elif not ids or ids[-1] != self.unknown:  # neighbouring unknown characters are one piece
                ids.append(p)
        return ids

    def encode(self, column: pa.Array, table: Dictionary) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, counts)."""
        if self.dummy_prefix:
            column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(" ", column, ""))
        pieces, counts = pieces_before_space(column, self.cut)
        ids, at, size = table.look_up(pieces)
        return ids[ranges(at, size)], per_row(np.add, size, counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, their sizes)."""
        size = self.text_size[ids]
        data = self.text[ranges(self.text_start[ids], size)]
        sizes = per_row(np.add, size, counts)
        if self.dummy_prefix:
            stay = np.ones(len(data), bool)
            first = (np.cumsum(sizes) - sizes)[sizes > 0]
            stay[first[data[first] == 32]] = False
            sizes = per_row(np.add, stay.astype(np.int64), sizes)
            data = data[stay]
        return data, sizes


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> tuple[Model, Dictionary]:
    """A file's model and its remembered words, once for each process."""
    with open(path, "rb") as f:
        model = Model(f.read())
    return model, Dictionary(lambda words: model.encode_words([w.replace(" ", MARK) for w in words]), 500_000)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = loaded(path)
        for batch in batches:
            for part in cuts(batch, BATCH_BYTES):
                ids, counts = model.encode(text_column(part), table)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = loaded(path)
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), [])
            counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
            data, sizes = model.decode(lists.flatten().to_numpy().astype(np.int64), counts)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def piece_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_crc32 (of little-endian 32-bit ids) and round_trip of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = loaded(path)
        for batch in batches:
            for part in cuts(batch, BATCH_BYTES):
                column = text_column(part)
                ids, counts = model.encode(column, table)
                data, sizes = model.decode(ids, counts)
                was, ends = raw(column)
                own = np.concatenate([[0], np.cumsum(sizes)])
                same = [np.array_equal(data[a:b], was[c:d]) for a, b, c, d in zip(own, own[1:], ends, ends[1:])]
                view, at = memoryview(ids.astype("<u4")).cast("B"), np.concatenate([[0], np.cumsum(counts)]).tolist()
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends)), pa.array(counts), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_bytes", "n_pieces", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_pieces long, ids_crc32 long, round_trip boolean")
