"""Golomb (Rice) coding of sorted fingerprints in numpy.

All quotients come first, in unary, then all remainders: both are read back
without a step for each value.
"""

from __future__ import annotations

import numpy as np


def parameter(n: int, universe: int) -> int:
    """Low bits that are stored plainly for ``n`` values below ``universe``."""
    return max(0, (universe // max(n, 1)).bit_length() - 1)


def encode(values: np.ndarray, universe: int) -> bytes:
    """Gaps of sorted values: quotients in unary, then the remainders' bits."""
    if not len(values):
        return b""
    k = parameter(len(values), universe)
    gaps = np.diff(values.astype(np.int64), prepend=0)
    unary = np.zeros(int((gaps >> k).sum()) + len(gaps), np.uint8)
    unary[np.cumsum((gaps >> k) + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1
    return np.packbits(np.concatenate([unary, rest.astype(np.uint8).ravel()])).tobytes()


def decode(blob: bytes, n: int, universe: int) -> np.ndarray:
    """The ``n`` sorted values of a blob."""
    if not n:
        return np.zeros(0, np.int64)
    k = parameter(n, universe)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    # a quotient sum is at most universe / 2**k, so the n-th marker lies within the head
    ends = np.flatnonzero(bits[: n + (universe >> k) + 1])[:n]
    start = int(ends[-1]) + 1
    rest = bits[start : start + n * k].reshape(n, k).astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum((np.diff(ends, prepend=-1) - 1 << k) + rest)
