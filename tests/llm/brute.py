"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import math
from collections import Counter

import xxhash


def words(text):
    return (text or "").encode().split()


def features(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.encode().split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def binomial_cdf(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def groups(ids, near):
    """{id: least id reachable} for a relation on places in ids."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(ids))]


def repeated(raws, length, keep):
    """For each text the list of flags of bytes to remove; texts in order."""
    at = {}
    for k, r in enumerate(raws):
        for i in range(len(r) - length + 1):
            at.setdefault(r[i : i + length], []).append((k, i))
    flags = [[False] * len(r) for r in raws]
    for found in at.values():
        if len(found) > 1:
            for k, i in found[keep == "first" :]:
                flags[k][i : i + length] = [True] * length
    return flags


def best_stretch(a, b):
    best = (0, 0)
    for i in range(len(a)):
        run = hits = 0
        for j in range(i, len(a)):
            run += 1 if a[j] == b[j] else -4
            hits += a[j] == b[j]
            if run > best[0]:
                best = (run, hits)
    return best
