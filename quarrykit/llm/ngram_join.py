"""Exact n-gram Jaccard join by signature trees.

Links are exact: ``den * |A and B| >= num * |A or B|`` over distinct n-word shingles, whole texts, no caps. Steps:

1. One pass counts shingles that a batch of texts shares and keeps the ``HOT`` most frequent ones as a bounded list
   (8 bytes each). It only orders shingles; any list gives the same links.
2. One pass makes a row a text: set size, set digest, a bitmap of one to two bits a shingle, and the prefix: the first
   n - ceil(t n) + 1 shingles in the order (rare before hot, then hash). Linked sets share a shingle of both prefixes.
   Texts with equal sets are one member from here on.
3. Prefix shingles are dealt by value; sorted runs of two members or more are groups. Groups with the same members are
   one. In each group a signature tree over the bitmaps is joined with itself; pairs that its bounds can't rule out
   become candidate edges, and of those only what connects the group. Two groups a member come first: groups whose
   members are connected by then need no bitmaps.
4. Connected candidates form small clusters; their sets come once more, from the texts, and a signature tree with a bit
   for every shared shingle gives the exact links and components.

Nothing is emitted by pair: a group gives fewer edges than members. Members within a group or cluster come sorted by
size in blocks of ``BLOCK``; blocks whose sizes can't match any more are let go.

Defined results: null or blank texts have no shingles and are their own component; rows with a null id are counted but
linked to nothing (null component); repeated ids are one member whose rows share a component; empty tables give no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import signature_tree as st
from quarrykit.llm import textkit as tk
from quarrykit.llm.graph import components, most_frequent, with_group
from quarrykit.llm.storage import dropped, written

HOT = 1 << 16
HOT_LEAST = 16
BLOCK = 2048
RUN = 1 << 16
MIN_BITS, MAX_BITS = 64, 1 << 15
SEEN = "id long, n long, digest binary, prefix array<long>, bits binary"


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def _sets(texts: list[bytes | None], n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, held in tk.chunks(texts):
        yield (first, *tk.distinct(*tk.Words(held).shingles(n)))


def hot_shingles(docs: DataFrame, n: int, text: str) -> np.ndarray:
    """At most ``HOT`` hashes, sorted by hash, with their order from rare to frequent."""

    def counted(batches):
        for b in batches:
            held = [h for _, h, _ in _sets(_texts(b, text), n)]
            if held:
                h, c = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[c > 1].view(np.int64)), pa.array(c[c > 1])], names=["h", "c"])

    seen = docs.select(text).mapInArrow(counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT_LEAST)
    seen = written(seen, "shared")
    rows = most_frequent(seen, "c", HOT).toPandas().sort_values(["c", "h"])  # bounded by HOT
    dropped(seen)
    h = rows["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return np.stack([h[order], order.astype(np.uint64)])


def _n_bits(size: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << int(size - 1).bit_length()))


def _described(docs: DataFrame, n: int, num: int, den: int, id_col: str, text: str, hot: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def rows(batches):
        values, rank = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, h, at in _sets(_texts(b, text), n):
                out: list[list] = [[], [], [], [], []]
                for k in range(len(at) - 1):
                    s = h[at[k] : at[k + 1]]
                    size = len(s)
                    out[0].append(ids[first + k])
                    out[1].append(size)
                    if not size:
                        for x in out[2:]:
                            x.append(None)
                        continue
                    length = size - -(-num * size // den) + 1
                    p = np.minimum(np.searchsorted(values, s), max(len(values) - 1, 0))
                    is_hot = values[p] == s if len(values) else np.zeros(size, dtype=bool)
                    # hash order among rare ones is fixed by mixing, so that prefixes don't follow bit ranges
                    prefix = s[~is_hot][:length]
                    if len(prefix) < length:
                        prefix = np.concatenate([prefix, s[is_hot][np.argsort(rank[p[is_hot]], kind="stable")][: length - len(prefix)]])
                    out[2].append(tk.mix(s + np.uint64(1)).sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(tk.mix(s ^ np.uint64(0xD1B54A32D192ED03))).tobytes())
                    out[3].append(prefix.view(np.int64))
                    out[4].append(st.hashed(s, _n_bits(size)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.binary())],
                    names=["id", "n", "digest", "prefix", "bits"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text)).mapInArrow(rows, SEEN)


def _run_batch(groups: list[np.ndarray], members: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(groups)), pa.array(np.concatenate(members))], names=["grp", "id"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by shingle and member: (group, member) of every run of two or more. A run's group is the hash of
    its members, or of its shingle where it has more than ``RUN``."""
    key_now: int | None = None
    held: list[np.ndarray] = []
    spilled = False
    groups: list[np.ndarray] = []
    members: list[np.ndarray] = []

    def close():
        if held:
            m = np.unique(np.concatenate(held))
            if spilled or len(m) > 1:
                g = key_now if spilled else int(tk.mix(m.view(np.uint64)).sum(dtype=np.uint64).view(np.int64))
                groups.append(np.full(len(m), g, dtype=np.int64))
                members.append(m)
            held.clear()

    for b in batches:
        if not b.num_rows:
            continue
        key, member = b.column(0).to_numpy(), b.column(1).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        last = np.append(first[1:], len(key))
        # runs of one are over unless they stand at an end of the batch
        some = last - first > 1
        some[[0, -1]] = True
        for f, t in zip(first[some].tolist(), last[some].tolist()):
            k = int(key[f])
            if k != key_now:
                close()
                key_now, spilled = k, False
            held.append(member[f:t])
            if sum(map(len, held)) > RUN:
                spilled = True
                close()
        if groups:
            yield _run_batch(groups, members)
            groups, members = [], []
    close()
    if groups:
        yield _run_batch(groups, members)


def _stars(ids: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    """Edges from each member to the first of its component."""
    apart = label != np.arange(len(label))
    return pd.DataFrame({"a": ids[apart], "b": ids[label[apart]]})


class _Window:
    """Members in order of size, in blocks; each new block meets itself and the blocks before it that it can match."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.blocks: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.total = 0
        self.met: dict[int, int] = {}
        self.joined = st.Joined(0)

    def add(self, ids: np.ndarray, sizes: np.ndarray, roots: np.ndarray, payload, pair) -> None:
        """``roots``: members with equal ones have met before."""
        at = np.arange(self.total, self.total + len(ids))
        known = [self.met.setdefault(r, i) for r, i in zip(roots.tolist(), at.tolist())]
        self.joined.label = np.concatenate([self.joined.label, at])
        self.joined.label[at] = self.joined.label[known]
        self.total += len(ids)
        self.ids.append(ids)
        self.blocks = [x for x in self.blocks if x[1].max() * self.den >= sizes.min() * self.num]
        tree = pair(payload, sizes, payload, sizes)[0]
        st.join(tree, tree, self.joined, at, at, self.num, self.den)
        for old_at, old_sizes, old in self.blocks:
            a, b = pair(old, old_sizes, payload, sizes)
            st.join(a, b, self.joined, old_at, at, self.num, self.den)
        self.blocks.append((at, sizes, payload))

    def edges(self) -> pd.DataFrame:
        return _stars(np.concatenate(self.ids), self.joined.label) if self.ids else pd.DataFrame({"a": [], "b": []}, dtype=np.int64)


def _by_bitmap(a: list[bytes], na: np.ndarray, b: list[bytes], nb: np.ndarray) -> tuple[st.Tree, st.Tree]:
    words = min(min(map(len, a)), min(map(len, b))) // 8

    def tree(x, n):
        bits = np.stack([st.folded(np.frombuffer(r, dtype=np.uint64), words) for r in x])
        return st.Tree(bits, n, n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))

    out = tree(a, na)
    return out, (out if a is b else tree(b, nb))


def _by_set(a: list[np.ndarray], na: np.ndarray, b: list[np.ndarray], nb: np.ndarray) -> tuple[st.Tree, st.Tree]:
    if a is b:
        tree = st.Tree(st.exact(a)[0], na, np.zeros(len(a), dtype=np.int64))
        return tree, tree
    bits, slack = st.exact([*a, *b])
    return st.Tree(bits[: len(a)], na, slack[: len(a)]), st.Tree(bits[len(a) :], nb, slack[len(a) :])


def _grouped(num: int, den: int, pair, decode):
    """Rows (group, id, size, root, set), sorted by group and size -> edges that connect each group's members."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, window, held = None, None, []

        def flush():
            if held:
                # bitmaps differ in length by size: a block holds one length
                for run in _equal_lengths(held):
                    window.add(np.array([r[0] for r in run]), np.array([r[1] for r in run]), np.array([r[2] for r in run]), [decode(r[3]) for r in run], pair)
                held.clear()

        def done():
            flush()
            edges = window.edges()
            return pa.RecordBatch.from_arrays([pa.array(edges["a"].to_numpy(np.int64)), pa.array(edges["b"].to_numpy(np.int64))], names=["a", "b"])

        for b in batches:
            for g, i, n, root, x in zip(*(c.to_pylist() for c in b.columns)):
                if g != key:
                    if window is not None:
                        yield done()
                    key, window = g, _Window(num, den)
                held.append((i, n, root, x))
                if len(held) >= BLOCK:
                    flush()
        if window is not None:
            yield done()

    return out


def _equal_lengths(rows: list[tuple]) -> Iterator[list[tuple]]:
    start = 0
    for k in range(1, len(rows) + 1):
        if k == len(rows) or _n_bits(rows[k][1]) != _n_bits(rows[start][1]):
            yield rows[start:k]
            start = k


def link_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, digest`` for each row of ``docs``; J >= num / den links."""
    hot = hot_shingles(docs, n, text)
    seen = written(_described(docs, n, num, den, id_col, text, hot), "sets")
    filled = seen.where("id is not null and n > 0")
    classes = written(with_group(filled.select("id", "digest"), ["digest"], "id", rep=(F.min, "id")).select("id", "rep").distinct(), "classes")
    reps = filled.join(classes.where("id = rep").select("id").distinct(), "id", "left_semi")

    dealt = reps.select(F.explode("prefix").alias("k"), "id").repartition("k").sortWithinPartitions("k", "id")
    members = written(dealt.mapInArrow(_runs, "grp long, id long").distinct(), "members")
    about = reps.select("id", "n", "bits").dropDuplicates(["id"])

    def candidates(rows: DataFrame) -> DataFrame:
        """``rows``: grp, id, root."""
        full = rows.join(about, "id").select("grp", "id", "n", "root", "bits").repartition("grp").sortWithinPartitions("grp", "n", "id")
        return full.mapInArrow(_grouped(num, den, _by_bitmap, lambda x: x), "a long, b long")

    # two groups a member first; what they connect settles most of the other groups without their bitmaps
    ends = members.groupBy("id").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).select(F.explode(F.array("x", "y")).alias("grp")).distinct()
    some = written(candidates(members.join(ends, "grp", "left_semi").withColumn("root", F.col("id"))), "candidates")
    rooted = members.join(components(some).withColumnRenamed("node", "id"), "id", "left").select("grp", "id", F.coalesce("root", "id").alias("root"))
    apart = rooted.groupBy("grp").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("grp")
    rest = rooted.join(apart, "grp", "left_semi").join(ends, "grp", "left_anti")
    edges = some.unionByName(candidates(rest))
    clusters = written(components(edges), "clusters")

    def again(batches):
        for b in batches:
            ids, cluster = b.column(0), b.column(1)
            for first, h, at in _sets(_texts(b, "text"), n):
                count = len(at) - 1
                size = np.diff(at)
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([cluster.slice(first, count), ids.slice(first, count), pa.array(size.astype(np.int64)), ids.slice(first, count), sets], names=["grp", "id", "n", "root", "bits"])

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text).alias("text")).join(clusters, "node")
    sets = texts.select("node", "root", "text").mapInArrow(again, "grp long, id long, n long, root long, bits array<long>")
    sets = sets.repartition("grp").sortWithinPartitions("grp", "n", "id")
    links = sets.mapInArrow(_grouped(num, den, _by_set, lambda x: np.array(x, dtype=np.int64).view(np.uint64)), "a long, b long")
    # classes of equal sets are linked through their first member
    equal = classes.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(equal))
    return seen.select("id", F.col("n").alias("n_shingles"), "digest").join(found, seen.id == found.node, "left").select("id", "n_shingles", F.coalesce("root", "id").alias("component_id"), "digest")


def query(spark, sf_dir: str) -> DataFrame:
    out = link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 9, 10)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = r"""
with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
sh as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) s from t where len(w) > 0)),
n as (select t.doc_id, count(s) n from t left join sh on sh.doc_id = t.doc_id group by 1),
o as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from n union select r.a, e.b from r join e on e.a = r.b)
select n.doc_id, n.n::bigint n_shingles, min(r.b) component_id from n join r on r.a = n.doc_id group by 1, 2
"""
