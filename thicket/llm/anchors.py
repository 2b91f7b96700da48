"""Fingerprints of bytes, and the positions ("anchors") at which a sparse suffix array keeps a suffix.

Of each string of ``length`` bytes the k-mer with the smallest fingerprint is its anchor, the leftmost of equal
ones; the choice depends on the string's bytes alone, so equal strings have their anchors at the same place. It
is enough to keep the suffixes that start at anchors: about 2 in length - K + 2 of all.
"""

from __future__ import annotations

import numpy as np

from thicket.llm.textbatch import mix

K = 64
CHUNK = 1 << 20  #: bytes worked on at a time

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(m)) for m in (0xD1342543DE82EF95, 0xA0761D6478BD642F)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, for the positions of a chunk."""
    if kind not in _POWERS:
        both = []
        for base in (_BASES[kind], pow(_BASES[kind], -1, 1 << 64)):
            x = np.full(CHUNK + 1, base, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[kind] = both[0], both[1]
    return _POWERS[kind]


class Fingerprints:
    """64-bit fingerprints of any substrings of at most CHUNK bytes, in constant time each; of two independent kinds."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        up, self.down = _powers(kind)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[kind][data] * up[: len(data)], out=self.sums[1:])

    def all_of(self, length: int) -> np.ndarray:
        """Of the substring of that length at each position."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i + w]) for each i, by minima from both ends of blocks of w."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchored(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[Fingerprints, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, row, first, last, anchor): the windows first..last of a row have their anchor in common.

    Rows are data[starts[i]:ends[i]], one after the other, at most CHUNK bytes in all. A window is named by the
    position in data at which it starts.
    """
    f = Fingerprints(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return f, none, none, none, none
    k = f.all_of(K)
    low = np.uint64(CHUNK - 1)
    k = (k & ~low) | np.arange(len(k), dtype=np.uint64)
    at = (sliding_min(k, length - K + 1) & low).astype(np.int64)
    inside = ends - starts >= length
    first, after = starts[inside], ends[inside] - length + 1
    mark = np.zeros(len(data) + 1, np.int8)
    mark[first] = 1
    mark[after] = -1  # windows that would end beyond the row; the next row starts later
    valid = np.cumsum(mark[: len(at)], dtype=np.int8).astype(bool)
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    s = np.flatnonzero(new)
    done = valid.copy()
    done[:-1] &= new[1:] | ~valid[1:]
    e = np.flatnonzero(done)
    return f, np.searchsorted(starts, s, "right") - 1, s, e, at[s]
