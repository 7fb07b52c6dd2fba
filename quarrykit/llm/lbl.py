"""Class-factored log-bilinear language model with noise-contrastive estimation, in numpy.

Units are the most frequent words (``head_words`` of them), the classes of all other words, and the end of a text. The context is the
two units before. A word's probability has two factors, each a normalised log-bilinear model with a diagonal map a place:

    P(unit | u, v)        ~ exp((c1 * r[u] + c2 * r[v]) . q[unit] + b[unit])                over all units
    P(word | class, u, v) ~ exp((d1 * r[u] + d2 * r[v]) . t[slot] + e[slot])                over the slots of the class

A class has a slot for each word of it that the dictionary knows, and one for the rest; of the rest, a word has the share
(count + 1) / (tokens + words + 1), which sums to one with one unseen word a class. So every word of the dictionary has an
embedding of its own, and every other one, seen or not, has a class: classes are ranges in the order of words' last two bytes
with even token mass, and parts by hash of endings that hold more, so mostly words with one ending share a class.

Training is noise-contrastive: batches of targets against shared noise drawn from the units' distribution, and words of a class against
that class's noise, of which the expectation is taken over all its slots. Both factors start at the smoothed unigrams. Normalisers of all (u, v) come once
from a product of two matrices; those of words in a class from one product a class over a batch of texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Head words at least, and cube roots of the training tokens.
HEAD, GROWTH = 958, 4
#: Classes of the other words, about.
CLASSES = 1024
DIM = 24
NOISE, CLASS_NOISE = 64, 8
BATCH, CLASS_BATCH = 4096, 256
#: Scores that are computed at a time.
CELLS = 1 << 17
RATE, CLASS_RATE = 0.15, 0.5
ROUNDS = 2
#: Where the sums of squared gradients begin.
SQUARE = np.float32(0.1)


def head_words(tokens: int) -> int:
    """Words with an output of their own, for a corpus of ``tokens`` training tokens."""
    return max(HEAD, int(GROWTH * tokens ** (1 / 3)))


ENDINGS = 1 << 16


def ending(word: bytes) -> int:
    """A word's place in the order of endings: its last byte, then the one before."""
    return (word[-1] << 8) + (word[-2] if len(word) > 1 else 0)


class Classes:
    """Ranges of endings with even token mass; an ending of more than that is dealt to several classes by a hash."""

    def __init__(self, tokens: np.ndarray):
        """``tokens``: of the words of each ending."""
        even = max(tokens.sum(), 1.0) / CLASSES
        self.parts = np.maximum(1, np.round(tokens / even)).astype(np.int64)
        many = self.parts > 1
        # a range ends where its mass is even, and around each ending that has classes of its own
        upto = np.cumsum(np.where(many, 0, tokens))
        kind = np.floor(upto / even) + np.cumsum(many) + np.concatenate([[0], np.cumsum(many)[:-1]])
        new = np.concatenate([[False], kind[1:] != kind[:-1]])
        before = np.concatenate([[1], self.parts[:-1]])
        self.base = np.cumsum(np.where(new, before, 0))
        self.n = int(self.base[-1] + self.parts[-1])

    def of(self, words: list[bytes]) -> np.ndarray:
        last = np.frombuffer(b"".join([w[-2:] if len(w) > 1 else b"\0" + w for w in words]), dtype=np.uint8).reshape(-1, 2)
        e = (last[:, 1].astype(np.int64) << 8) + last[:, 0]  # ``ending`` of each
        parts = self.parts[e]
        out = self.base[e]
        many = np.flatnonzero(parts > 1)
        h = np.fromiter(map(zlib.crc32, map(words.__getitem__, many.tolist())), dtype=np.int64, count=len(many))
        out[many] += h * parts[many] >> 32
        return out


def _add(sums: np.ndarray, at: np.ndarray, rows: np.ndarray, pairs: np.ndarray) -> None:
    """Adds ``rows`` to the rows of ``sums`` at these places, repeats too. Two numbers go as a complex one, which halves the additions;
    ``pairs`` has the places of each row's pairs."""
    np.add.at(sums.reshape(-1).view(np.complex64), pairs.take(at, axis=0).ravel(), rows.reshape(-1).view(np.complex64))


def _above(score: np.ndarray) -> np.ndarray:
    """1 + exp(score), in place; the logistic function of -score is its reciprocal. Beyond float32 it is infinite, and that 0."""
    np.exp(score, out=score)
    score += 1
    return score


@dataclass
class Model:
    unigram: np.ndarray  # of units
    first: np.ndarray  # first slot of each class, and the end
    share: np.ndarray  # of slots in their class
    r: np.ndarray = field(default=None)
    c: np.ndarray = field(default=None)
    q: np.ndarray = field(default=None)
    d: np.ndarray = field(default=None)
    t: np.ndarray = field(default=None)
    squares: dict = field(default=None)  # of gradients so far

    @staticmethod
    def fresh(units: np.ndarray, first: np.ndarray, slots: np.ndarray) -> Model:
        """From token counts of units and slots. The last column of ``q`` and ``t`` is the bias."""
        rng = np.random.default_rng(7)
        p = (units + 1.0) / (units.sum() + len(units))
        s = slots + 1.0
        s /= np.repeat(np.add.reduceat(s, first[:-1]), np.diff(first)) if len(s) else 1.0
        small = lambda n: (rng.standard_normal((n, DIM)) * 0.1).astype(np.float32)
        biased = lambda x, bias: np.concatenate([x, np.log(bias)[:, None].astype(np.float32)], axis=1)
        maps = np.full((2, DIM), 0.5, dtype=np.float32)
        return Model(p, first, s, small(len(p) + 1), maps, biased(small(len(p)), p), maps.copy(), biased(np.zeros((len(s), DIM), dtype=np.float32), s))

    @property
    def tables(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in "rcqdt"}

    def copy(self) -> Model:
        return Model(self.unigram, self.first, self.share, **{k: v.copy() for k, v in self.tables.items()})

    def _step(self, name: str, g: np.ndarray, rate: float, scale: np.float32, table: np.ndarray | None = None) -> None:
        """AdaGrad by row of a table, or of a wider copy of it, for ``scale * g``; rows that a batch doesn't name have no gradient and stay."""
        state = self.squares[name]
        state += np.einsum("ij,ij->i", g, g) * (scale * scale / np.float32(getattr(self, name).shape[1]))
        g *= (np.float32(rate) * scale / np.sqrt(state))[:, None]
        table = getattr(self, name) if table is None else table
        table += g

    def train(self, u: np.ndarray, v: np.ndarray, unit: np.ndarray, slot: np.ndarray, rng: np.random.Generator, slow: float = 1.0) -> None:
        """One pass over (two units before, unit, slot or -1), in batches; the state of the steps goes on from call to call."""
        if self.squares is None:
            self.squares = {k: np.full(len(x), SQUARE) for k, x in self.tables.items()}
        with np.errstate(over="ignore"):  # of ``_above``
            self._train_units(u, v, unit, rng, slow)
            self._train_classes(u, v, unit, slot, slow)

    def _train_units(self, u: np.ndarray, v: np.ndarray, unit: np.ndarray, rng: np.random.Generator, slow: float) -> None:
        noise_p = np.log(self.unigram * NOISE).astype(np.float32)
        cumulative = np.cumsum(self.unigram)
        # a column for the bias, and an even width for ``_add``; maps are repeated by row, as whole tables multiply faster
        pad = ((0, 0), (0, 1 + (DIM + 1) % 2))
        q, r = np.pad(self.q, (pad[0], (0, pad[1][1] - 1))), np.pad(self.r, pad)
        r[:, DIM] = 1
        pairs = np.arange(r.size // 2).reshape(len(r), -1)
        c = np.zeros((2, *r.shape), dtype=np.float32)
        c[0, :, DIM] = 1
        gq, gx, gy, spare = np.empty((4, *r.shape), dtype=np.float32)
        gq = gq[: len(q)]
        ones = np.ones(len(r), dtype=np.float32)
        for s in range(0, len(unit), BATCH):
            x, y, w = (a[s : s + BATCH] for a in (u, v, unit))
            k = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), len(cumulative) - 1)
            scale = np.float32(len(w) ** -0.5)
            c[:, :, :DIM] = self.c[:, None]
            p = np.multiply(r, c[0], out=spare).take(x, axis=0)
            p += np.multiply(r, c[1], out=spare).take(y, axis=0)
            gp, qk = q.take(w, axis=0), q.take(k, axis=0)
            # d(log-likelihood)/ds: 1 - P(data) for the target, -P(data) for each noise unit
            dp = 1 / _above(np.einsum("ij,ij->i", p, gp) - noise_p[w])
            away = -qk
            away[:, DIM] += noise_p[k]
            dn = _above(p @ away.T)
            np.reciprocal(dn, out=dn)
            gp *= dp[:, None]
            gp -= dn @ qk
            gp[:, DIM:] = 0
            noise = dn.T @ p
            np.negative(noise, out=noise)
            p *= dp[:, None]
            for g in (gq, gx, gy):
                g[:] = 0
            _add(gq, w, p, pairs)
            _add(gq, k, noise, pairs)
            _add(gx, x, gp, pairs)
            _add(gy, y, gp, pairs)
            maps = np.stack([ones @ np.multiply(g, r, out=spare) for g in (gx, gy)])[:, :DIM]
            gx *= c[0]
            gy *= c[1]
            gx += gy
            self._step("q", gq, RATE * slow, scale, q)
            self._step("r", gx, RATE * slow, scale, r)
            self._step("c", maps, RATE * slow, scale)
        self.q[:], self.r[:] = q[:, : DIM + 1], r[:, :DIM]

    def _train_classes(self, u: np.ndarray, v: np.ndarray, unit: np.ndarray, slot: np.ndarray, slow: float) -> None:
        """Words against the noise of their class, whose expectation is taken over all slots of the class."""
        first, second = (np.pad(self.r, ((0, 0), (0, 1)), constant_values=bias) for bias in (1, 0))
        d = np.pad(self.d, ((0, 0), (0, 1)), constant_values=1)
        maps, state_d = np.empty_like(d), self.squares["d"]
        row, ones = np.arange(CLASS_BATCH), np.ones(CLASS_BATCH, dtype=np.float32)
        even = np.full(DIM + 1, 1 / np.float32(DIM + 1))
        for at, a, b in self._classes(unit, slot):
            t, state = self.t[a:b], self.squares["t"][a:b]
            ratio = (CLASS_NOISE * self.share[a:b]).astype(np.float32)
            log_ratio, less = np.log(ratio), -ratio
            x, y, place = u[at], v[at], slot[at] - a
            for s in range(0, len(at), CLASS_BATCH):
                rx, ry = first.take(x[s : s + CLASS_BATCH], axis=0), second.take(y[s : s + CLASS_BATCH], axis=0)
                p = rx * d[0]
                p += ry * d[1]
                away = -t
                away[:, DIM] += log_ratio
                sure = _above(p @ away.T)
                own = row[: len(p)] * (b - a)
                own += place[s : s + CLASS_BATCH]
                target = 1 - 1 / sure.reshape(-1).take(own)
                np.divide(less, sure, out=sure)
                sure.reshape(-1)[own] += target
                gp = sure @ t
                g = sure.T @ p
                state += (g * g) @ even
                g *= (np.float32(CLASS_RATE * slow) / np.sqrt(state))[:, None]
                t += g
                rx *= gp
                ry *= gp
                np.dot(ones[: len(p)], rx, out=maps[0])
                np.dot(ones[: len(p)], ry, out=maps[1])
                maps[:, DIM] = 0
                maps *= np.float32(len(p) ** -0.5)
                state_d += (maps * maps).sum(axis=1) / np.float32(DIM)
                maps *= (np.float32(RATE * slow) / np.sqrt(state_d))[:, None]
                d += maps
        self.d[:] = d[:, :DIM]

    def log_normalisers(self) -> np.ndarray:
        """log of the sum of exp(s) over units for every context (u, v). exp(s) is a product of a factor of (u, w) and one of
        (v, w), so the sums over w are a matrix product, taken in runs of contexts."""
        size = len(self.r)
        out = np.empty((size, size), dtype=np.float32)
        q, b = self.q[:, :DIM], self.q[:, DIM]
        second = (self.c[1] * self.r) @ q.T + b
        top = second.max(axis=1, keepdims=True)
        second = np.exp(second - top)
        for u in range(0, size, 256):
            first = (self.c[0] * self.r[u : u + 256]) @ q.T
            high = first.max(axis=1, keepdims=True)
            out[u : u + 256] = np.log(np.maximum(np.exp(first - high) @ second.T, np.finfo(np.float32).tiny)) + high + top[:, 0]
        return out

    def log_p(self, u: np.ndarray, v: np.ndarray, unit: np.ndarray, slot: np.ndarray, normal: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of units, and of slots where they are not negative."""
        out = np.empty(len(unit), dtype=np.float64)
        first, second = self.c[0] * self.r, self.c[1] * self.r
        for s in range(0, len(unit), 1 << 16):
            x, y, w = (a[s : s + (1 << 16)] for a in (u, v, unit))
            q = self.q.take(w, axis=0)
            p = first.take(x, axis=0)
            p += second.take(y, axis=0)
            out[s : s + (1 << 16)] = np.einsum("ij,ij->i", p, q[:, :DIM]) + q[:, DIM] - normal.reshape(-1).take(x.astype(np.int64) * normal.shape[1] + y)
        first, second = (np.pad(d * self.r, ((0, 0), (0, 1)), constant_values=bias) for d, bias in zip(self.d, (1, 0)))
        for every, a, b in self._classes(unit, slot):
            t = self.t[a:b]
            x, y, place = u[every], v[every], slot[every] - a
            step = max(1, CELLS // (b - a))
            for s in range(0, len(every), step):
                p = first.take(x[s : s + step], axis=0)
                p += second.take(y[s : s + step], axis=0)
                scores = p @ t.T
                if not (scores.max() < 60 and scores.min() > -60):  # else no sum of their exp leaves float32
                    scores -= scores.max(axis=1)[:, None]
                own = scores.reshape(-1).take(np.arange(len(p)) * (b - a) + place[s : s + step])
                out[every[s : s + step]] += own - np.log(np.exp(scores, out=scores).sum(axis=1))
        return out

    def _classes(self, unit: np.ndarray, slot: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """(places of the words of a class, its first slot, its end), for each class that occurs."""
        tail = np.flatnonzero(slot >= 0)
        kind = (unit[tail] - (len(self.unigram) - len(self.first))).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        tail = tail[order]
        edge = np.searchsorted(kind[order], np.arange(len(self.first)))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            yield tail[edge[k] : edge[k + 1]], int(self.first[k]), int(self.first[k + 1])
