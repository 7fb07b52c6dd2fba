"""Words and hashes of many texts at once, in numpy.

Words are runs of bytes other than ASCII white space, lower-cased in A-Z only. All hashes are 64 bits: a word is the
polynomial of its bytes modulo 2**64, mixed, or, beyond ``LONG_WORD`` bytes, its BLAKE2 digest (such polynomials have known clashes from
1,024 bytes on); a shingle mixes its words' hashes with their places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Texts are taken together up to about this many bytes, so that the arrays stay small; a longer text goes alone.
CHUNK = 1 << 20
LONG_WORD = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE).cumprod(dtype=np.uint64)])
            _inverse = np.concatenate([[np.uint64(1)], np.full(n - 1, back).cumprod(dtype=np.uint64)])
    return _powers[:n], _inverse[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[b] - P[a], times the inverse power a, the polynomial of data[a:b]."""
    power, _ = _grown(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of data[start:end] each, the same wherever the same bytes stand."""
    _, back = _grown(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def chunks(texts: list[bytes | None], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, texts) of consecutive texts that have ``size`` bytes together, or of one longer text."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and total + len(t) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(t)
        total += len(t) + 1
    if held:
        yield first, held


class Words:
    """The words of some texts: ``hash`` of each, ``doc`` index, and ``first`` word of each text (one more at the end);
    ``start`` and ``end`` in ``data``, the lower-cased bytes of all texts with a space after each."""

    def __init__(self, texts: list[bytes]):
        self.data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
        gap = np.ones(len(self.data) + 1, dtype=bool)
        gap[1:] = _SPACE[self.data]
        edge = gap[1:] != gap[:-1]
        at = np.flatnonzero(edge)
        self.start, self.end = at[::2], at[1::2]
        self.hash = span_hashes(prefix_sums(self.data), self.start, self.end)
        for k in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            self.hash[k] = int.from_bytes(hashlib.blake2b(self.data[self.start[k] : self.end[k]].tobytes(), digest_size=8).digest(), "big")
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.n)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first shingle of each text and the end): runs of n words, or all words of a text that has fewer."""
        padded = np.concatenate([self.hash, np.zeros(n, dtype=np.uint64)])
        total = len(self.hash)
        last = self.first[1:][self.doc]  # first word after the text
        place = np.arange(total)
        out = np.zeros(total, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                word = np.where(place + k < last, padded[k : k + total], np.uint64(0))
                out = mix(out + word + np.uint64(k + 1))
        keep = (place + n <= last) | (place == self.first[:-1][self.doc])
        count = np.zeros(len(self.n) + 1, dtype=np.int64)
        count[1:] = np.cumsum(np.where(self.n > 0, np.maximum(self.n - n + 1, 1), 0))
        return out[keep], count


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted and without repeats inside each text; the new firsts."""
    out = hashes.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), dtype=bool)
    if len(out):
        keep[1:] = out[1:] != out[:-1]
        keep[first[:-1][np.diff(first) > 0]] = True
    sums = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], sums[first]
