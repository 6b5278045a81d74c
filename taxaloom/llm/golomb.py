"""Golomb-Rice coding of sorted distinct integers, vectorised: quotients in unary, remainders in fixed width."""

from __future__ import annotations

import numpy as np


def rice_bits(span: int, n: int) -> int:
    """Width of the remainder for ``n`` values spread over ``span``: the power of two nearest below their mean gap."""
    return max(0, (max(1, int(span)) // max(1, int(n))).bit_length() - 1)


def encode(values: np.ndarray, width: int) -> bytes:
    """Code sorted, distinct, unsigned ``values`` as gaps; two streams, each padded to whole bytes."""
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    high = (gaps >> np.uint64(width)).astype(np.int64)
    stops = np.cumsum(high + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 1
    low = ((gaps[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def decode(data: bytes, n: int, width: int) -> np.ndarray:
    """The ``n`` values that ``encode`` was given."""
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    tail = (n * width + 7) // 8
    bits = np.unpackbits(raw[: len(raw) - tail])
    high = np.diff(np.flatnonzero(bits)[:n], prepend=-1).astype(np.uint64) - np.uint64(1)
    low = np.unpackbits(raw[len(raw) - tail :])[: n * width].reshape(n, width).astype(np.uint64)
    rest = (low << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if width else np.zeros(n, np.uint64)
    return np.cumsum((high << np.uint64(width)) | rest, dtype=np.uint64)
