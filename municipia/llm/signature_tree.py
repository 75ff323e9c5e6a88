"""Signature trees over token sets, in numpy: what one task does with the members of one block.

A member has a size and a bitmap with one bit for each hash class of its tokens. A node over some members keeps their
bitmaps OR-combined, the range of their sizes, and the largest slack (tokens less bits). For members a and b of nodes A and
B, with c bits common to both bitmaps, overlap(a, b) <= min(c + slack A, c + slack B, size A, size B); a pair of nodes whose
bound stays below what the threshold asks of the smallest sizes holds no pair and is dropped with all below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

FAN = 16
#: Bytes of bitmaps compared at once; node pairs beyond it wait on a stack.
CHUNK_BYTES = 2_000_000


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """uint64 words with two bits or more for each token of a set, a power of two in all, 64 at least."""
    width = max(64, 1 << int(2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    bits = np.zeros(width, np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap as one of ``words`` words."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0) if len(bits) > words else bits


@dataclass
class Level:
    bits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    slack: np.ndarray
    group_low: np.ndarray
    group_high: np.ndarray

    def above(self) -> "Level":
        at = np.arange(0, len(self.low), FAN)
        r = lambda f, x: f.reduceat(x, at, axis=0)
        return Level(r(np.bitwise_or, self.bits), r(np.minimum, self.low), r(np.maximum, self.high), r(np.maximum, self.slack), r(np.minimum, self.group_low), r(np.maximum, self.group_high))


class Tree:
    """Members in the order given (sorted by size keeps ranges narrow); group: members of one need no pair."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        slack = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [Level(bits, sizes, sizes, slack, groups, groups)]
        while len(self.levels[-1].low) > FAN:
            self.levels.append(self.levels[-1].above())


def most_common(a: Level, i: np.ndarray, b: Level, j: np.ndarray) -> np.ndarray:
    """The bound on the overlap of any pair under nodes i of a and j of b."""
    common = np.bitwise_count(a.bits[i] & b.bits[j]).sum(axis=1, dtype=np.int64)
    return np.minimum(np.minimum(common + a.slack[i], common + b.slack[j]), np.minimum(a.high[i], b.high[j]))


def comparable(a: Level, i: np.ndarray, b: Level, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes alone leave a pair, and not all members are of one group."""
    one = (a.group_low[i] == a.group_high[i]) & (b.group_low[j] == b.group_high[j]) & (a.group_low[i] == b.group_low[j])
    return (den * a.high[i] >= num * b.low[j]) & (den * b.high[j] >= num * a.low[i]) & ~one


def _children(nodes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    spread = nodes[:, None] * FAN + np.arange(FAN)
    return np.minimum(spread, count - 1), spread < count


def possible_pairs(a: Tree, b: Tree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i of a, j of b, bound / sum of sizes) of the pairs of members that the bound leaves; j < i if a is b."""
    same = a is b
    chunk = max(256, CHUNK_BYTES // (8 * a.levels[0].bits.shape[1]))
    width = len(b.levels[-1].low)
    gi, gj = np.divmod(np.arange(len(a.levels[-1].low) * width), width)
    stack = [(len(a.levels) - 1, len(b.levels) - 1, gi, gj)]
    while stack:
        la, lb, i, j = stack.pop()
        if len(i) > chunk:
            stack.append((la, lb, i[chunk:], j[chunk:]))
            i, j = i[:chunk], j[:chunk]
        if same:  # both sides are at one level; pairs right of the diagonal mirror the others
            keep = j <= i if la else j < i
            i, j = i[keep], j[keep]
        keep = comparable(a.levels[la], i, b.levels[lb], j, num, den)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        most, sizes = most_common(a.levels[la], i, b.levels[lb], j), a.levels[la].low[i] + b.levels[lb].low[j]
        keep = (num + den) * most >= num * sizes
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if la == lb == 0:
            yield i, j, most[keep] / sizes[keep]
            continue
        na, nb = (la - 1 if la >= lb else la), (lb - 1 if lb >= la else lb)
        ci, oki = _children(i, len(a.levels[na].low)) if na < la else (i[:, None], np.ones((len(i), 1), bool))
        cj, okj = _children(j, len(b.levels[nb].low)) if nb < lb else (j[:, None], np.ones((len(j), 1), bool))
        ok = (oki[:, :, None] & okj[:, None, :]).ravel()
        shape = (len(i), ci.shape[1], cj.shape[1])
        stack.append((na, nb, np.broadcast_to(ci[:, :, None], shape).ravel()[ok], np.broadcast_to(cj[:, None, :], shape).ravel()[ok]))


def traverse(a: Tree, b: Tree, num: int, den: int, best_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Possible pairs (i, j). best_only: of every member of either tree only the pair with the highest bound, so there are
    no more pairs than members."""
    found = [(i, j, s) for i, j, s in possible_pairs(a, b, num, den)] if not best_only else []
    if not best_only:
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    na = len(a.levels[0].low)
    shift = 0 if a is b else na
    best, partner = np.full(shift + len(b.levels[0].low), -1.0), np.full(shift + len(b.levels[0].low), -1)
    for i, j, s in possible_pairs(a, b, num, den):
        me, other, score = np.concatenate([i, j + shift]), np.concatenate([j + shift, i]), np.concatenate([s, s])
        better = score > best[me]
        me, other, score = me[better], other[better], score[better]
        order = np.argsort(score, kind="stable")  # of one member's pairs the best is written last
        best[me[order]], partner[me[order]] = score[order], other[order]
    me = np.flatnonzero(partner >= 0)
    i, j = np.maximum(me, partner[me]), np.minimum(me, partner[me])
    return (i, j) if a is b else (j, i - shift)
