"""Hashed byte n-grams of whole texts."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time, so that memory does not follow the longest text.
PIECE = 1 << 20


def bucket_counts(data: bytes, bits: int, size: int = 3, table: np.ndarray | None = None) -> np.ndarray:
    """How many of the ``size``-byte grams of ``data`` fall into each of ``2**bits`` buckets.

    ``table`` maps bytes to bytes first. Text shorter than a gram has none.
    """
    counts = np.zeros(1 << bits, dtype=np.int64)
    for start in range(0, max(0, len(data) - size + 1), PIECE):
        piece = np.frombuffer(data, dtype=np.uint8, count=min(PIECE + size - 1, len(data) - start), offset=start)
        if table is not None:
            piece = table[piece]
        mixed = np.zeros(len(piece) - size + 1, dtype=np.uint32)
        for k in range(size):
            mixed *= np.uint32(257)
            mixed += piece[k : len(piece) - size + 1 + k]
        mixed *= np.uint32(2654435761)
        mixed >>= np.uint32(32 - bits)
        counts += np.bincount(mixed, minlength=1 << bits)
    return counts
