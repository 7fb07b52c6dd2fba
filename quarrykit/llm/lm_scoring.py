"""Scoring of texts by a class-factored log-bilinear model (``lbl``) and by smoothed unigrams.

Tokens: words lower-cased in A-Z, and one end a text. Texts whose crc32 of the id modulo ``FOLDS`` is ``HELD`` are held out. A word of
more than ``LONGEST`` bytes goes by its digest, so every key is short, however frequent its word is.

1. Every training token is counted (batches are combined before the shuffle): the count table, N and V cover the
   corpus. The most frequent words, ``KNOWN`` at most, are a bounded dictionary for the tasks, found by a histogram of the counts.
2. One pass encodes every text as numbers of the dictionary, into a table.
3. Training texts are dealt by a hash of the row into shards, whose number is the square root of the training tokens over a
   constant; a shard is sorted by that hash. So the model depends on the rows, not on files or partitions. Each shard trains over
   all its tokens from a common start; a shuffle by rows of parameters averages them by the squares of their gradients.
4. A pass over the encoded texts scores them. Words beyond the dictionary are left as (text, word, times) rows, which meet the
   count table by word: the dictionary has the frequent ones, so no task is hot.

Memory in a task: the dictionary, the model (its rows are the dictionary's), a run of texts, and the normalisers of the contexts (10 MB,
and 200 MB at 5e9 tokens). To the driver come the dictionary and the model. Defined results: null and blank texts are one end token; rows
without an id are held out if crc32 of the empty text says so (it does not); repeated rows count as often as they stand;
texts and words of any length are whole; columns of the input that clash with names here don't matter, as only id and
text are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import lbl
from quarrykit.llm.graph import most_frequent
from quarrykit.llm.storage import written

FOLDS, HELD = 7, 2
KNOWN = 1 << 17
LONGEST = 48
#: Distinct words that a task holds before it passes its counts on.
FLUSH = 200_000
#: Shards are the square root of the training tokens over this.
SHARD = 1 << 20
#: Rows of the model that travel together.
BLOCK = 256
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def _words(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []  # bytes part at ASCII white space alone


def _key(word: bytes) -> bytes:
    """Words have no blank, so the digest of a long one is no other word; its last two bytes are kept for the class."""
    return word if len(word) <= LONGEST else b" " + hashlib.sha256(word).digest()[:24] + word[-2:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, count); the end of a text has the empty word."""
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array([w if len(w) <= LONGEST else _key(w) for w in held], pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    for b in batches:
        for t in b.column(0).cast(pa.binary()).to_pylist():
            held.update(_words(t))
            held[b""] += 1
            if len(held) > FLUSH:
                yield out()
                held.clear()
    if held:
        yield out()


class Dictionary:
    """Numbers for words. Below ``units`` they are units of the model (head words by rank, classes, the end); others are, less
    ``units``, slots: class after class the known words by rank, then one for the rest of the class."""

    def __init__(self, words: list[bytes], counts: list[int], ending_tokens: np.ndarray, n: int, v: int, ends: int):
        """``words`` fall by count; ``ending_tokens``: of all words by ``lbl.ending``."""
        self.n, self.v, self.ends = n, v, ends
        self.heads = min(lbl.head_words(n), len(words))
        head, tail = words[: self.heads], words[self.heads :]
        tokens = ending_tokens.astype(np.float64)
        np.subtract.at(tokens, [lbl.ending(w) for w in head], counts[: self.heads])
        self.classes = lbl.Classes(np.maximum(tokens, 0))
        kind = self.classes.of(tail)
        self.units = self.heads + self.classes.n + 1
        self.end, self.start = self.units - 1, self.units
        self.first = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=self.classes.n) + 1)])
        order = np.argsort(kind, kind="stable")
        slot = np.empty(len(tail), dtype=np.int64)
        slot[order] = np.arange(len(tail)) + kind[order]  # a rest before each further class
        self.rest = self.first[1:] - 1
        self.id = {w: i for i, w in enumerate(head)}
        self.id |= {w: i for w, i in zip(tail, (slot + self.units).tolist())}
        self.count = np.zeros(self.units + int(self.first[-1]))
        self.count[: self.heads] = counts[: self.heads]
        self.count[self.units + slot] = counts[self.heads :]
        self.count[self.end] = ends
        self.unit_of = np.concatenate([np.arange(self.units), self.heads + np.repeat(np.arange(self.classes.n), np.diff(self.first))]).astype(np.int32)
        self.slot_of = np.concatenate([np.full(self.units, -1), np.arange(self.first[-1])]).astype(np.int32)

    def rests(self, tokens: np.ndarray, words: np.ndarray) -> None:
        """Takes the tokens and the words of each class beyond the dictionary."""
        self.count[self.units + self.rest] = tokens
        self.rest_norm = np.log(tokens + words + 1.0)

    def model(self) -> lbl.Model:
        slots = self.count[self.units :]
        units = self.count[: self.units].copy()
        units[self.heads : self.end] = np.add.reduceat(slots, self.first[:-1])
        return lbl.Model.fresh(units, self.first, slots)

    def encoded(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[Counter]]:
        """(numbers, first of each text and the end, words beyond the dictionary of each text), an end after each text."""
        words: list = []
        first = [0]
        for t in texts:
            words += _words(t)
            words.append(b"")
            first.append(len(words))
        get = self.id.get
        ids = np.fromiter(map(get, words, repeat(-1)), dtype=np.int32, count=len(words))
        first = np.array(first)
        ids[first[1:] - 1] = self.end
        left = np.flatnonzero(ids < 0)
        keys = list(map(words.__getitem__, left.tolist()))
        long = [k for k, w in enumerate(keys) if len(w) > LONGEST]
        if long:  # the dictionary has them by their digests
            for k in long:
                keys[k] = _key(keys[k])
                ids[left[k]] = get(keys[k], -1)
            rare = ids[left] < 0
            left, keys = left[rare], [w for w, r in zip(keys, rare.tolist()) if r]
        ids[left] = self.units + self.rest[self.classes.of(keys)]
        split = np.searchsorted(left, first).tolist()
        return ids, first, [Counter(keys[a:b]) for a, b in zip(split, split[1:])]

    def targets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, slot or -1) of each number."""
        return self.unit_of.take(ids), self.slot_of.take(ids)


def _contexts(units: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The units two and one before each token; ``start`` before a text."""
    one, two = np.empty_like(units), np.empty_like(units)
    one[1:] = units[:-1]
    one[first[:-1]] = start
    two[1:] = one[:-1]
    two[first[:-1]] = start
    return two, one


def _slices(values: list[bytes | None], size: int = 1 << 22) -> Iterator[tuple[int, list]]:
    """Runs of values of about ``size`` bytes together, with the place of the first."""
    first, total = 0, 0
    for i, t in enumerate(values):
        total += len(t or b"")
        if total >= size:
            yield first, values[first : i + 1]
            first, total = i + 1, 0
    if first < len(values):
        yield first, values[first:]


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))


def dictionary(counts: DataFrame) -> Dictionary:
    """From the count table. To the driver come the dictionary, ``lbl.ENDINGS`` sums and two numbers a class."""
    words = counts.where("word <> X''")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.expr("word = X''"), F.col("c"))).alias("e")).first()
    top = most_frequent(words, "c", KNOWN).toPandas()
    top["word"] = top["word"].map(bytes)
    top = top.sort_values(["c", "word"], ascending=[False, True])
    size = F.octet_length("word")
    byte = lambda at: F.conv(F.hex(F.expr(f"substring(word, {at}, 1)")), 16, 10).cast("int")
    code = byte("octet_length(word)") * 256 + F.when(size > 1, byte("octet_length(word) - 1")).otherwise(0)
    by_ending = words.groupBy(code.alias("e")).agg(F.sum("c").alias("c")).toPandas()
    tokens = np.zeros(lbl.ENDINGS)
    tokens[by_ending["e"].to_numpy(dtype=np.int64)] = by_ending["c"].to_numpy(dtype=np.float64)
    out = Dictionary(top["word"].tolist(), top["c"].tolist(), tokens, total.n or 0, total.v, total.e or 0)
    known = counts.sparkSession.sparkContext.broadcast((out.classes, set(out.id)))

    def beyond(batches):
        classes, held = known.value
        for b in batches:
            word = b.column(0).to_pylist()
            rare = [k for k, w in enumerate(word) if w not in held]
            kind, c = classes.of([word[k] for k in rare]), b.column(1).to_numpy()[rare]
            n = np.bincount(kind, minlength=classes.n)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.bincount(kind, weights=c, minlength=classes.n)[some]), pa.array(n[some])], names=["k", "c", "n"])

    sums = words.mapInArrow(beyond, "k long, c double, n long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).toPandas()
    rest = np.zeros((2, out.classes.n))
    rest[:, sums["k"].to_numpy(dtype=np.int64)] = sums["c"].to_numpy(dtype=np.float64), sums["n"].to_numpy(dtype=np.float64)
    out.rests(*rest)
    known.destroy()
    return out


ENCODED = "doc_id long, held_out boolean, ids binary, n_known long, base double, rare array<struct<word:binary,n:long>>"


def encoded(rows: DataFrame, words) -> DataFrame:
    def out(batches):
        known = words.value
        logs = np.log10(known.count + 1)
        logs[known.units + known.rest] = 0  # these words are left as rows
        seen = known.count > 0
        seen[known.units + known.rest] = False
        for b in batches:
            for at, texts in _slices(b.column(2).cast(pa.binary()).to_pylist()):
                ids, first, rare = known.encoded(texts)
                m = len(texts)
                cut = first.tolist()
                times = [n for c in rare for n in c.values()]
                left = pa.StructArray.from_arrays([pa.array([w for c in rare for w in c], pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, m), b.column(1).slice(at, m), pa.array([_packed(ids[a:z]) for a, z in zip(cut, cut[1:])], pa.binary()), pa.array(np.add.reduceat(seen[ids].astype(np.int64), first[:-1])),
                     pa.array(np.add.reduceat(logs[ids], first[:-1])), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(c) for c in rare])]), pa.int32()), left)],
                    names=["doc_id", "held_out", "ids", "n_known", "base", "rare"],
                )

    return rows.mapInArrow(out, ENCODED)


def _packed(ids: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, and so on: the higher ones are alike and compress well."""
    return ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _decoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(t) // 4 for t in texts]
    first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    out = np.empty((int(first[-1]), 4), dtype=np.uint8)
    for k in range(4):
        out[:, k] = np.frombuffer(b"".join([t[k * n : (k + 1) * n] for t, n in zip(texts, sizes)]), dtype=np.uint8)
    return out.reshape(-1).view("<i4"), first


def trained(texts: DataFrame, words, n_tokens: int) -> lbl.Model:
    """From rows of (h, ids). Shards train from the same start; the mean of each row of parameters, weighted by the squares of
    its gradients in each shard, starts the next round."""
    context = texts.sparkSession.sparkContext
    shards = max(1, math.ceil(math.sqrt(n_tokens / SHARD)))
    model = words.value.model()
    dealt = texts.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    for r in range(lbl.ROUNDS):
        start = context.broadcast(model)

        def shard(batches, start=start, r=r):
            now, mine, rng, held, size = None, None, None, [], 0

            def run():
                ids, first = _decoded(held)
                unit, slot = words.value.targets(ids)
                two, one = _contexts(unit, first, words.value.start)
                order = rng.permutation(len(unit))
                mine.train(two[order], one[order], unit[order], slot[order], rng, 1 / (1 + r))
                held.clear()

            def out():
                run()
                for name, table in mine.tables.items():
                    weight = mine.squares[name] - lbl.SQUARE
                    for k in range(0, len(table), BLOCK):
                        if weight[k : k + BLOCK].any():
                            rows = (weight[k : k + BLOCK].astype(np.float64), table[k : k + BLOCK])
                            yield pa.RecordBatch.from_pydict({"name": [name], "k": pa.array([k], pa.int64()), "n": pa.array([rows[0].tobytes()], pa.binary()), "x": pa.array([rows[1].tobytes()], pa.binary())})

            for b in batches:
                for s, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                    if s != now:
                        if now is not None:
                            yield from out()
                        now, mine, size, rng = s, start.value.copy(), 0, np.random.default_rng([s, r])
                    held.append(ids)
                    size += len(ids)
                    if size >= 1 << 22:
                        run()
                        size = 0
            if now is not None:
                yield from out()

        shape = "name string, k long, n binary, x binary"
        rows = dealt.select("shard", "h", "ids").repartitionById(shards, "shard").sortWithinPartitions("shard", "h", "ids").mapInArrow(shard, shape)
        means = rows.repartition("name", "k").mapInArrow(_means, shape).collect()  # as many numbers as the model has
        if not means:
            break
        model = model.copy()
        for row in means:
            table, weight = model.tables[row["name"]], np.frombuffer(row["n"])
            at = np.flatnonzero(weight)
            table[row["k"] + at] = np.frombuffer(row["x"], dtype=np.float32).reshape(len(weight), -1)[at]
        start.destroy()
    return model


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of the model from many shards -> the weighted mean of each block (a weight of 0: no shard had the row)."""
    sums: dict[tuple, list] = {}
    for b in batches:
        for name, k, n, x in zip(*(c.to_pylist() for c in b.columns)):
            n = np.frombuffer(n)
            x = np.frombuffer(x, dtype=np.float32).reshape(len(n), -1) * n[:, None]
            if (name, k) in sums:
                sums[name, k][0] += n
                sums[name, k][1] += x
            else:
                sums[name, k] = [n.copy(), x]
    for (name, k), (n, x) in sums.items():
        mean = (x / np.maximum(n, np.finfo(np.float64).tiny)[:, None]).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"name": [name], "k": pa.array([k], pa.int64()), "n": pa.array([n.tobytes()], pa.binary()), "x": pa.array([mean.tobytes()], pa.binary())})


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, log10."""
    rows = _rows(docs, id_col, text)
    training = rows.where("not held_out").select("text")
    counts = written(training.mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    known = dictionary(counts)
    context = docs.sparkSession.sparkContext
    words = context.broadcast(known)
    n, v = known.n, known.v
    passed = written(encoded(rows, words).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = trained(passed.where("not held_out").select(F.xxhash64("doc_id", "ids").alias("h"), "ids"), words, n)
    shared = context.broadcast((model, model.log_normalisers()))

    def scored(batches):
        lm, normal = shared.value
        own = words.value
        for b in batches:
            for at, texts in _slices(b.column(5).to_pylist()):
                ids, first = _decoded(texts)
                unit, slot = own.targets(ids)
                two, one = _contexts(unit, first, own.start)
                p = lm.log_p(two, one, unit, slot, normal)
                in_rest = np.flatnonzero(slot >= 0)
                in_rest = in_rest[own.rest[unit[in_rest] - own.heads] == slot[in_rest]]
                p[in_rest] -= own.rest_norm[unit[in_rest] - own.heads]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, len(texts)) for c in b.columns[:5]), pa.array(np.diff(first)), pa.array(np.add.reduceat(p, first[:-1]) / math.log(10))],
                    names=["row", "doc_id", "held_out", "n_known", "base", "n_tokens", "score"],
                )

    shape = "row long, doc_id long, held_out boolean, n_known long, base double, n_tokens long, score double"
    modelled = passed.select("row", "doc_id", "held_out", "n_known", "base", "ids").mapInArrow(scored, shape)
    left = passed.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    found = left.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs"))
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return modelled.join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + more).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
