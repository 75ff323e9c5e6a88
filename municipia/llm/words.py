"""Words and shingles of Arrow text columns as 64-bit hashes, on bytes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0xB492B66FBE98F273
#: The bytes that part words (blank, tab, line feed, vertical tab, form feed, carriage return).
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(BLANKS)] = False


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, A-Z in lower case; none for null."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        yield from (np.zeros(0, np.uint64) for _ in range(len(column)))
        return
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    up, down = _powers(max(16, int(len(data)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    words = mix((sums[ends] - sums[starts]) * down[starts])
    cuts = np.searchsorted(starts, offsets)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield words[a:b]


@lru_cache(maxsize=4)
def _factors(k: int) -> np.ndarray:
    return mix(np.arange(k, dtype=np.uint64), 7) | np.uint64(1)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k successive words; of all of them as one if there are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    f = _factors(k)
    if n < k:
        return mix(np.sum(words * f[:n], keepdims=True, dtype=np.uint64), n)
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total += words[i : n - k + 1 + i] * f[i]
    return np.unique(mix(total, k))
