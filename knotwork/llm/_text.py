"""Vectorised hashing of words, shingles and byte windows over whole texts.

A span's hash is a polynomial in 64-bit arithmetic over seeded byte codes, read from prefix sums, so that
every span of a slice costs a few array operations whatever its length.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = U(0x9E3779B97F4A7C15)
BACK = U(pow(int(STEP), -1, 2**64))
PLACE = _rng.integers(1, 2**63, 8, dtype=np.uint64) * U(2) + U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODES = CODES[LOWER]

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and STEP**-i for i below n at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        for k, base in enumerate((STEP, BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def prefix_sums(data: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * PLACE[7])


def words(data: np.ndarray, offs: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are not ``outside``), and the rows' bounds among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~outside[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = offs[:-1][offs[:-1] < len(data)]
    first[heads] = inside[heads]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lowered, the rows' bounds among them, and the words' starts and ends."""
    starts, ends, rows = words(data, offs, outside)
    return span_hash(prefix_sums(data, LOWER_CODES), starts, ends), rows, starts, ends


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of the k words from each word on; the last k-1 places hold nothing of use."""
    out = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= k:
        body = out[: len(hashes) - k + 1]
        for j in range(k):
            body += hashes[j : len(hashes) - k + 1 + j] * PLACE[j]
        out[: len(body)] = mix(body)
    return out


def shingle_rows(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each row's distinct shingles, sorted: k words each; fewer words are one shingle, no words none."""
    hashes, rows, _, _ = word_hashes(data, offs)
    grams = shingles(hashes, k)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            short = (hashes[a:b] * PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.full(1, b - a, np.uint64) * PLACE[6]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
