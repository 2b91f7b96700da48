"""Slow, plain versions of the operators, to hold their results against."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Union:
    def __init__(self, items):
        self.of = {x: x for x in items}

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def tie(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)] if words else [])


def near_groups(docs, percent=80):
    """{doc_id: (n_shingles, component_id, kept)} of {doc_id: text}."""
    sets, groups = {i: shingles(t) for i, t in docs.items()}, Union(docs)
    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                groups.tie(i, j)
    return {i: (len(sets[i]), groups.find(i), groups.find(i) == i) for i in ids}


def suffix_dedup(docs, length=200):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    data = {i: (t or "").encode() for i, t in docs.items()}
    count = Counter(b[i : i + length] for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in data.items():
        keep = bytearray(b"\1" * len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                keep[i : i + length] = bytes(length)
        kept = bytes(x for x, y in zip(b, keep) if y)
        out[k] = (len(b), len(b) - len(kept), len(re.findall(rb"\0+", bytes(keep))), hashlib.sha256(kept).hexdigest())
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
