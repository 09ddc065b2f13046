"""Randomly rotated one-bit codes of vectors with correction factors, and the inner-product estimates that they give.

A unit vector is rotated at random into more dimensions and kept as the signs of its coordinates, a corner of the cube.
The stored factor is the inner product of the vector and that corner. For another unit vector q, <corner, q> / factor is
an unbiased estimate of the inner product, with an error of sqrt((1 - f^2) / f^2 / (bits - 1)) in standard deviations.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=4)
def rotation(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    """The part of a random rotation that vectors of ``dim`` padded to ``bits`` dimensions need: bits x dim, orthonormal columns."""
    bits = max(bits, dim)
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, bits]).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: object) -> np.ndarray | None:
    """The vector in double precision; None if it is null, empty, zero or holds null or non-finite components."""
    if vector is None or len(vector) == 0:
        return None
    x = np.array([np.nan if c is None else c for c in vector], np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encoded(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs (rows of bytes) and correction factors of the rows of x."""
    y = unit(x) @ rotation(x.shape[1], bits).T
    return np.packbits(y > 0, axis=1), np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])


def signs(codes: np.ndarray) -> np.ndarray:
    return np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1


def estimates(queries: np.ndarray, codes: np.ndarray, factors: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of each query (rows) with each code (columns), and the half width of each code's bound."""
    bits = codes.shape[1] * 8
    q = (unit(queries) @ rotation(queries.shape[1], bits).T).astype(np.float32)
    found = (q @ signs(codes).T) / np.sqrt(np.float32(bits)) / factors.astype(np.float32)
    return found, sigmas * np.sqrt((1 - factors**2) / factors**2 / (bits - 1)) + 1e-5


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b in double precision, summed from the first component to the last."""
    dot, x, y = (np.cumsum(p, axis=1)[:, -1] for p in (a * b, a * a, b * b))
    return dot / (np.sqrt(x) * np.sqrt(y))
