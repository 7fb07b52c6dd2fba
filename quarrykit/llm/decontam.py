"""Benchmark decontamination by SimHash windows.

Each benchmark item of m words has a 64-bit SimHash over its weighted five-word shingles. Windows of m words over a text are
fingerprinted the same way. Multi-index Hamming blocks find every item within ``RADIUS`` of a window: with ``BLOCKS`` bytes a
fingerprint, two fingerprints within the radius agree in one byte up to ``RADIUS // BLOCKS`` bits, and a table of 256 entries a
byte lists the items. Items are numbered by their total weight, so of each list only those are taken whose weight lets
them reach the threshold with the window's. Candidates are verified exactly: weighted Jaccard of the window's and the item's shingles of
``THRESHOLD`` or more. A shingle's weight falls with the number of items that hold it.

Texts and items are compared in lower case, by their words of letters and digits.

A window can reach the threshold only if it holds shingles of the item, so windows are laid only where a text has one:
the places come from one vectorised lookup of all the text's shingles, and windows start at every place that puts the
item's own words in line with the text (and two words to either side). No other window can pass the verification.

The benchmark's index (arrays: 40 bytes a shingle of an item and 50 an item; bounded by the benchmark, whose size is checked) is
broadcast; texts are read once, whole, without a shuffle. Columns of the input may have any names: where it has a column ``hits``
already, ``scanned`` puts its own in that place, and ``clean`` returns the input's. Defined results: null, blank and shorter texts match nothing unless they are
the whole item; items under five words are one shingle of their own length, looked up at every place of a text; items
without an id count as others do (their hits have a null id); blank or null items match nothing; empty tables work;
repeated rows pass one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import textkit as tk

N = 5
BLOCKS = 8
RADIUS = 23
THRESHOLD = 0.8
SHIFT = 2
#: Items beyond this need another distribution of the index; the operator says so instead of broadcasting it.
MOST_ITEMS = 2_000_000
#: ASCII punctuation parts words as white space does.
_PLAIN = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))
#: The bytes that differ from each byte in ``RADIUS // BLOCKS`` bits at most.
NEAR = [[a for a in range(256) if (a ^ b).bit_count() <= RADIUS // BLOCKS] for b in range(256)]
HITS = "array<struct<item_id:bigint,start_word:bigint,n_words:bigint,hamming:int,similarity:double>>"


def plain(text: str) -> bytes:
    """Lower case, words of letters and digits: what a copy keeps when its case and punctuation change."""
    return text.lower().encode().translate(_PLAIN)


def _bits(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of a shingle's 64 bits."""
    mixed = tk.mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as bytes."""
    return np.packbits(sums > 0, axis=1)


class Index:
    """Items, their shingles with weights, and the Hamming tables."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = [(i, plain(t)) for i, t in rows if t is not None]
        words = tk.Words([t for _, t in rows])
        h, first = words.shingles(N)
        alive = np.flatnonzero(words.n >= N)
        # items under N words: length -> hash -> ids
        self.short: dict[int, dict[int, list]] = {}
        for m in range(1, N):
            own, at = words.shingles(m)
            for k in np.flatnonzero(words.n == m).tolist():
                self.short.setdefault(m, {}).setdefault(int(own[at[k]]), []).append(rows[k][0])
        sets = [np.unique(h[first[k] : first[k + 1]], return_index=True) for k in alive]
        every = np.concatenate([x for x, _ in sets]) if sets else np.zeros(0, dtype=np.uint64)
        self.shingles, df = np.unique(every, return_counts=True)
        self.weights = 1.0 / (1.0 + np.log(df.astype(np.float64)))
        total = np.array([self.weight(x).sum() for x, _ in sets])
        # items by total weight
        order = np.argsort(total, kind="stable")
        sets, alive, self.total = [sets[k] for k in order], alive[order], total[order]
        self.ids, self.n_words = [rows[k][0] for k in alive], words.n[alive]
        # each item's shingles, sorted, with the word of the item at which each first stands
        self.first = np.concatenate([[0], np.cumsum([len(x) for x, _ in sets])]).astype(np.int64)
        self.own = np.concatenate([x for x, _ in sets]) if sets else every
        self.place = np.concatenate([p for _, p in sets]).astype(np.int32) if sets else np.zeros(0, dtype=np.int32)
        at = np.searchsorted(self.shingles, self.own)
        by = np.argsort(at, kind="stable")
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), np.diff(self.first))[by]
        self.owner_first = np.concatenate([[0], np.cumsum(df)])
        prints = [_packed((_bits(x) * self.weight(x)[:, None]).sum(axis=0, keepdims=True)) for x, _ in sets]
        self.prints = np.concatenate(prints) if prints else np.zeros((0, 8), dtype=np.uint8)
        # for each byte of a fingerprint the items by its value, and where each value begins
        self.lists = [np.argsort(self.prints[:, b], kind="stable").astype(np.int32) for b in range(BLOCKS)]
        self.begins = [np.searchsorted(self.prints[x, b], np.arange(257)) for b, x in enumerate(self.lists)]
        # lookup of all shingles of a text: one bit by low bits of the hash, then the sorted list
        self.low = np.zeros(1 << 22, dtype=bool)
        self.low[(self.shingles & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def item(self, n: int) -> np.ndarray:
        """The sorted shingles of an item."""
        return self.own[self.first[n] : self.first[n + 1]]

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        """1 for shingles that no item holds."""
        out = np.ones(len(shingles))
        if len(self.shingles):
            p = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
            known = self.shingles[p] == shingles
            out[known] = self.weights[p[known]]
        return out

    def known(self, h: np.ndarray) -> np.ndarray:
        """Places of ``h`` that hold a shingle of some item."""
        at = np.flatnonzero(self.low[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(at) or not len(self.shingles):
            return at[:0]
        p = np.minimum(np.searchsorted(self.shingles, h[at]), len(self.shingles) - 1)
        return at[self.shingles[p] == h[at]]

    def within(self, fingerprint: np.ndarray, least: float = 0.0, most: float = float("inf")) -> np.ndarray:
        """All items within the radius of a fingerprint whose total weight is in ``least`` to ``most``, by the Hamming lists."""
        low, high = (int(np.searchsorted(self.total, x, side)) for x, side in ((least, "left"), (most, "right")))
        found = []
        for b in range(BLOCKS):
            items, begin = self.lists[b], self.begins[b]
            for value in NEAR[int(fingerprint[b])]:
                part = items[begin[value] : begin[value + 1]]  # rises inside a value
                found.append(part[np.searchsorted(part, low) : np.searchsorted(part, high)])
        found = np.unique(np.concatenate(found))
        distance = np.bitwise_count(self.prints[found] ^ fingerprint).sum(axis=1)
        return found[distance <= RADIUS]

    def hits(self, h: np.ndarray, n_words: int) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, Hamming distance, similarity): the best window of each item that passes, the first of equal
        ones, for a text with the shingles ``h`` in order."""
        places = self.known(h)
        if not len(places):
            return []
        windows = set()
        for p, k in zip(places.tolist(), np.searchsorted(self.shingles, h[places]).tolist()):
            for n in self.owner[self.owner_first[k] : self.owner_first[k + 1]].tolist():
                start = p - int(self.place[self.first[n] + np.searchsorted(self.item(n), h[p])])
                m = int(self.n_words[n])
                for s in range(start - SHIFT, start + SHIFT + 1):
                    s = min(max(s, 0), max(n_words - m, 0))
                    windows.add((s, min(m, n_words)))
        best: dict[int, tuple] = {}
        for s, m in sorted(windows):
            shingles = np.unique(h[s : s + max(m - N + 1, 1)])
            w = self.weight(shingles)
            mass = float(w.sum())
            fingerprint = _packed((_bits(shingles) * w[:, None]).sum(axis=0, keepdims=True))[0]
            for n in self.within(fingerprint, mass * THRESHOLD - 1e-9, mass / THRESHOLD + 1e-9).tolist():
                both = w[np.isin(shingles, self.item(n), assume_unique=True)].sum()
                similarity = both / (mass + self.total[n] - both)
                if similarity >= THRESHOLD and similarity > best.get(n, (0, 0, 0, 0, 0.0))[4]:
                    distance = int(np.bitwise_count(self.prints[n] ^ fingerprint).sum())
                    best[n] = (self.ids[n], s, m, distance, float(similarity))
        return list(best.values())

    def short_hits(self, words: tk.Words) -> dict[int, list[tuple[int, int, int, int, float]]]:
        """For each text that holds items under ``N`` words: these items, at their first places."""
        out: dict[int, list] = {}
        for m, items in self.short.items():
            h, first = words.shingles(m)
            text_of = np.repeat(np.arange(len(words.n)), np.diff(first))
            at = np.flatnonzero(np.isin(h, np.array(list(items), dtype=np.uint64)) & (words.n[text_of] >= m))
            seen = set()
            for p, k, value in zip(at.tolist(), text_of[at].tolist(), h[at].tolist()):
                if (k, value) not in seen:
                    seen.add((k, value))
                    out.setdefault(k, []).extend((i, p - int(first[k]), m, 0, 1.0) for i in items[value])
        return out


def scanned(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``hits``: for each text the items it holds, with their best windows (empty where it holds none)."""
    rows = benchmark.select("item_id", "text").limit(MOST_ITEMS + 1).collect()  # the benchmark, not the corpus
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"the benchmark has more than {MOST_ITEMS} items: its index would not fit a broadcast")
    index = docs.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in rows]))

    @F.pandas_udf(HITS)
    def hits(series):
        import pandas as pd

        texts = [None if t is None else plain(t) for t in series]
        out: list = []
        for _, held in tk.chunks(texts):
            words = tk.Words(held)
            h, first = words.shingles(N)
            some = np.zeros(len(h) + 1, dtype=np.int64)
            some[1:][index.value.known(h)] = 1
            some = np.cumsum(some)
            short = index.value.short_hits(words)
            for k in range(len(held)):
                a, b = first[k], first[k + 1]
                found = index.value.hits(h[a:b], int(words.n[k])) if some[b] > some[a] else []
                found = sorted(found + short.get(k, []), key=lambda x: (x[0] is None, x[0] or 0, x[1:]))
                out.append([dict(zip(("item_id", "start_word", "n_words", "hamming", "similarity"), x)) for x in found])
        return pd.Series(out)

    return docs.withColumn("hits", hits(F.col(text)))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the texts that hold an item of the benchmark."""
    names = [f"_in{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*names)
    held = scanned(own, benchmark, text=names[docs.columns.index(text)])
    return held.where(F.size("hits") == 0).select(*names).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scanned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.transform("hits", lambda x: x["item_id"]).alias("item_ids"), F.array_max(F.transform("hits", lambda x: x["similarity"])).alias("similarity"))
