"""Skew-proof group minima and connected components of large edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.storage import dropped, written

SALTS = 64
#: Edges that one task joins (16 MB); more are contracted in parallel first.
ONE_TASK = 1 << 20


def with_group(df: DataFrame, key: list[str], spread: str, **aggregates) -> DataFrame:
    """``df`` with aggregates of its groups (name=(function, column), functions that combine with themselves, such as
    ``F.min`` and ``F.max``) and ``group_rows``. A group that holds a third of all rows is dealt to ``SALTS`` tasks by the hash of
    ``spread``: the aggregates come back once a (group, salt) that exists, so the join never multiplies rows."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(*key, "_salt").agg(F.count("*").alias("group_rows"), *(f(c).alias(n) for n, (f, c) in aggregates.items()))
    whole = parts.groupBy(*key).agg(F.sum("group_rows").alias("group_rows"), F.collect_list("_salt").alias("_salts"), *(f(n).alias(n) for n, (f, _) in aggregates.items()))
    dealt = whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(dealt, [*key, "_salt"]).drop("_salt")


def most_frequent(counts: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the highest counts, ``most`` at most, cut between sixteenths of an octave. A histogram of the counts (a
    thousand rows) finds the cut, so that nothing is sorted and no task sends more than belongs to the result."""
    step = F.floor(F.log2(count) * 16)
    hist = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True)
    cut, total = None, 0
    for row in hist:
        total += row.n
        if total > most:
            break
        cut = row.step
    return counts.where(F.lit(False) if cut is None else step >= cut)


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        node, root = connected(table["a"].to_numpy(), table["b"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b; no nulls), the root being the component's smallest node.

    While the edges are too many for one task, each node points to its smallest neighbour, pointers are followed to
    their ends and edges contracted to those: every round at least halves the nodes that have edges. Each round is a
    table in the shared folder."""
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None  # node -> root so far
    while links.count() > ONE_TASK:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p")).withColumnRenamed("a", "node"), "pointers")
        while True:
            over = up.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            next_up = written(up.join(over, "p").select("node", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "pointers")
            moved = next_up.where("moved").limit(1).count()
            dropped(up)
            up = next_up.drop("moved")
            if not moved:
                break
        up = up.withColumnRenamed("p", "root")
        left = links.join(up, links.a == up.node).select(F.col("root").alias("a"), "b")
        left = left.join(up, left.b == up.node).select("a", F.col("root").alias("b"))
        contracted = written(left.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        labels = written(_through(labels, up), "labels")
        links = contracted
    last = links.coalesce(1).mapInArrow(_joined, "node long, root long")
    return _through(labels, last)


def _through(labels: DataFrame | None, step: DataFrame) -> DataFrame:
    if labels is None:
        return step
    then = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return labels.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
