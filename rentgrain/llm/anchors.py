"""Content-defined anchors of byte strings, by which equal windows of two texts find each other."""

from __future__ import annotations

import numpy as np

#: Bytes of an anchor, whose hash decides which anchor a window takes.
GRAM = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they have been asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            grown, inverse = max(size, 2 * len(self.up)), np.uint64(pow(int(BASE), -1, 1 << 64))
            self.up, self.down = (
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(grown, x, dtype=np.uint64)]), dtype=np.uint64)
                for x in (BASE, inverse)
            )
        return self.up, self.down


POWERS = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position."""
    up, down = POWERS.get(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    return mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` neighbours from each position, from running minima of blocks."""
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: position, first and last start of the windows that take it, hash.

    A window of ``window`` bytes takes the leftmost of its grams with the least hash, so equal windows
    take it at equal distances from their starts. Every window belongs to exactly one anchor.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < window:
        return none, none, none, none
    width = window - GRAM + 1
    hashes = gram_hashes(data)
    least = sliding_minimum(hashes, width)
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.concatenate([begin[1:], [len(least)]])
    values, rank = np.unique(least[begin], return_inverse=True)
    # Where the hashes that won somewhere occur: first by 16 bits of them, then exactly.
    marked = np.zeros(1 << 16, dtype=bool)
    marked[(values & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(marked[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    place = np.minimum(np.searchsorted(values, hashes[at]), len(values) - 1)
    true = values[place] == hashes[at]
    at, place = at[true], place[true]
    order = np.lexsort((at, place))
    at, place = at[order], place[order]
    before = np.where(np.concatenate([[False], place[1:] == place[:-1]]), np.concatenate([[0], at[:-1]]), -1)
    # The last run of windows with this hash that starts at or before the occurrence.
    size = len(hashes) + 1
    run_order = np.lexsort((begin, rank))
    runs = (rank * size + begin)[run_order]
    run = np.searchsorted(runs, place * size + at, side="right") - 1
    valid = run >= 0
    run = run_order[np.maximum(run, 0)]
    valid &= rank[run] == place
    first = np.maximum(np.maximum(before + 1, at - width + 1), begin[run])
    last = np.minimum(at, end[run] - 1)
    valid &= first <= last
    return at[valid], first[valid], last[valid], hashes[at[valid]].view(np.int64)
