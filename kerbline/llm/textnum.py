"""Vectorised word splitting and hashing of whole texts: numpy on the bytes of a batch."""

from __future__ import annotations

import numpy as np

#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (xor-shift and multiply), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64; grown when a batch is longer than those before."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text after lower-casing A-Z, and offsets: text i has words offsets[i]:offsets[i+1]."""
    data = [x.encode("utf-8", "surrogatepass") if x else b"" for x in texts]
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    raw = np.frombuffer((b" " + b" ".join(data) + b" ").lower(), np.uint8)
    space = SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[0::2] + 1, edge[1::2] + 1  # the batch begins and ends with a space
    summed = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), out=summed[1:])
    h = (summed[end] - summed[start]) * powers(INVERSE, len(raw))[start]
    h += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    ends = np.cumsum(lengths + 1)  # where each text ends in raw
    offsets = np.zeros(len(texts) + 1, np.int64)
    offsets[1:] = np.searchsorted(start, ends, side="right")
    return mixed(h), offsets


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles (the whole sequence where it has fewer words; none without words) and their offsets."""
    counts = np.diff(offsets)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    if not len(words):
        return np.zeros(0, np.uint64), out
    first = np.repeat(offsets[:-1] - out[:-1], n) + np.arange(out[-1])
    h = np.full(len(first), 0x2545F4914F6CDD1D, np.uint64)
    length = np.repeat(np.minimum(counts, k), n)
    for j in range(k):
        has = length > j
        if has.all():
            h = mixed(h * np.uint64(BASE) + words[first + j])
        elif has.any():
            h[has] = mixed(h[has] * np.uint64(BASE) + words[first[has] + j])
    return h, out
