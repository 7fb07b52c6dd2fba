"""Signature trees: sets as bitmaps under hierarchical nodes.

A node holds the OR of its sets' bitmaps, the range of their sizes and the largest slack (tokens beyond set bits). No
pair below two nodes can share more tokens than the common bits plus the smaller slack, so a dual traversal prunes
node pairs whose bound falls short of what the smallest sizes need. Where every shared token has a bit of its own the
slack is 0 and the bound at the leaves is the exact overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quarrykit.llm.graph import connected

FAN = 16
_STEP = 1 << 18  # words compared at a time


@dataclass
class Level:
    bits: np.ndarray  # nodes x words
    low: np.ndarray
    high: np.ndarray
    slack: np.ndarray


class Tree:
    """Over sets given as rows of bits (uint64 words) with their sizes; rows keep the caller's order."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, slack: np.ndarray):
        self.levels = [Level(bits, sizes, sizes, slack)]
        while len(self.levels[-1].low) > 1:
            x = self.levels[-1]
            first = np.arange(0, len(x.low), FAN)
            self.levels.append(Level(np.bitwise_or.reduceat(x.bits, first, axis=0), np.minimum.reduceat(x.low, first), np.maximum.reduceat(x.high, first), np.maximum.reduceat(x.slack, first)))


def needed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest overlap of sets of these sizes with den * overlap >= num * union."""
    return -(-num * (a + b) // (num + den))


def _passing(a: Level, i: np.ndarray, b: Level, j: np.ndarray, num: int, den: int) -> np.ndarray:
    ok = (a.high[i] * den >= b.low[j] * num) & (b.high[j] * den >= a.low[i] * num)
    at = np.flatnonzero(ok)
    step = max(1, _STEP // a.bits.shape[1])
    for s in range(0, len(at), step):
        k = at[s : s + step]
        x, y = i[k], j[k]
        common = np.bitwise_count(a.bits[x] & b.bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(a.slack[x], b.slack[y])
        common = np.minimum(common, np.minimum(a.high[x], b.high[y]))
        ok[k] = common >= needed(a.low[x], b.low[y], num, den)
    return ok


class Joined:
    """Components over n members, as a label each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Takes in many links at once: what they connect gets the smallest label, in one pass over the members."""
        p, q = self.label[a], self.label[b]
        apart = p != q
        if apart.any():
            nodes, roots = connected(p[apart], q[apart])
            new = np.arange(len(self.label))
            new[nodes] = roots
            self.label = new[self.label]


def join(a: Tree, b: Tree, joined: Joined, in_a: np.ndarray, in_b: np.ndarray, num: int, den: int) -> None:
    """Links in ``joined`` (``in_a``, ``in_b``: the rows' members there) all pairs that pass; pairs whose members have
    met are left out, since another link between them changes no component."""
    same = a is b
    while len(a.levels) < len(b.levels):
        a.levels.append(a.levels[-1])
    while len(b.levels) < len(a.levels):
        b.levels.append(b.levels[-1])
    _descend(a, b, len(a.levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), same, joined, in_a, in_b, num, den)


def _children(tree: Tree, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if tree.levels[level] is tree.levels[level - 1]:
        return node, node + 1
    return node * FAN, np.minimum((node + 1) * FAN, len(tree.levels[level - 1].low))


def _descend(a, b, level, i, j, same, joined, in_a, in_b, num, den) -> None:
    ok = _passing(a.levels[level], i, b.levels[level], j, num, den)
    i, j = i[ok], j[ok]
    if level == 0:
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        joined.link(in_a[i], in_b[j])
        return
    # The nearest pairs first, so that later ones have mostly met; few node pairs at a time bound the memory.
    order = np.argsort(np.abs(i - j), kind="stable")
    i, j = i[order], j[order]
    step = 256
    for s in range(0, len(i), step):
        fi, ti = _children(a, level, i[s : s + step])
        fj, tj = _children(b, level, j[s : s + step])
        x, y = _product(fi, ti, fj, tj)
        if same:
            keep = x <= y
            x, y = x[keep], y[keep]
        if level == 1:
            keep = joined.label[in_a[x]] != joined.label[in_b[y]]
            x, y = x[keep], y[keep]
        if len(x):
            _descend(a, b, level - 1, x, y, same, joined, in_a, in_b, num, den)


def _product(fi, ti, fj, tj):
    """All (x, y) with fi <= x < ti and fj <= y < tj, for each place of the arrays."""
    ni, nj = ti - fi, tj - fj
    n = ni * nj
    at = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return fi[at] + k // nj[at], fj[at] + k % nj[at]


def hashed(tokens: np.ndarray, n_bits: int) -> np.ndarray:
    """A bitmap of ``n_bits`` (a power of two); half the bits of it OR-ed are the bitmap of half the size."""
    out = np.zeros(n_bits, dtype=bool)
    out[(tokens & np.uint64(n_bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def exact(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bits, slack 0) of sets: every token that two or more of them hold has a bit."""
    sizes = np.array([len(s) for s in sets])
    tokens, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    width = max(1, -(-int((count > 1).sum()) // 64))
    bits = np.zeros((len(sets), width), dtype=np.uint64)
    shared = count[at] > 1
    row, col = np.repeat(np.arange(len(sets)), sizes)[shared], place[at[shared]]
    np.bitwise_or.at(bits, (row, col // 64), np.uint64(1) << (col % 64).astype(np.uint64))
    return bits, np.zeros(len(sets), dtype=np.int64)
