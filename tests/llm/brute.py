"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text: str | None) -> set[tuple]:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(rows: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    sets = {d: shingle_set(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def removed(rows: list[tuple[int, str | None]], width: int = 200) -> dict[int, tuple[int, int, int, str]]:
    return {d: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, (n, gone, spans, kept) in kept_bytes(rows, width).items()}


def kept_bytes(rows: list[tuple[int, str | None]], width: int = 200) -> dict[int, tuple[int, int, int, bytes]]:
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + width] for _, b in raw for i in range(len(b) - width + 1))
    out = {}
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[d] = (len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def leaks(rows: list[tuple[int, str | None]], items: list[tuple[int, str]], percent: int = 75) -> set[tuple[int, int]]:
    def grams(w: list[str]) -> list[tuple]:
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    found = set()
    for i, text in items:
        own, size = Counter(grams(words(text))), len(words(text))
        for d, t in rows:
            g = grams(words(t))
            n = min(size - 4, len(g))
            if size < 5 or n < 1:
                continue
            for s in range(len(g) - n + 1):
                c = Counter(g[s : s + n])
                low, high = sum((c & own).values()), sum((c | own).values())
                if 100 * low >= percent * high:
                    found.add((d, i))
                    break
    return found
