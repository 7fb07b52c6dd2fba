"""Variable-capacity best-fit packing.

Pieces of texts go into bins of several permitted lengths. Pieces come by falling length, each into the open bin with
the least room that takes it; where none does, the bin opened is the permitted length of least cost for the piece, and at the
end every bin shrinks to the least permitted length that holds its contents. What a length costs is a parameter (tokens
plus a charge for a bin, by default). The permitted lengths are optimised jointly: a group is packed once for each
opening rule (the least cost among lengths of at least f times the piece, for several f), and the cheapest result stays.

Texts longer than the largest length are cut into pieces of it and a rest. Rows are dealt by a hash of id, length and row
into groups of about ``GROUP`` texts and each group is packed by itself: only ids and lengths move, tasks are even, and with
thousands of texts in a group what groups lose against one global packing is less than a bin of each length. The number of
groups follows the number of rows.

Defined results: null and blank texts have the end token only; rows without an id are packed like others; repeated
rows are packed one by one, and no id, however often it stands, fills a group; of bins with equal room the one that got this room
last takes a piece; of opening rules of equal cost the first counts; texts of any length are cut, none is dropped; columns of the
input may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096, 8192)
GROUP = 16_384
BIN_CHARGE = 16
FACTORS = (1.0, 1.5, 2.0, 4.0, float("inf"))
OUT = "pack_group long, bin long, capacity int, slot int, offset int, doc_id long, piece int, token_start long, n_tokens int"


def cost(capacity: int) -> float:
    return capacity + BIN_CHARGE


def best_fit(sizes: list[int], lengths: tuple[int, ...], factor: float, price=cost) -> tuple[list[int], list[int], float]:
    """(bin of each piece, capacity of each bin, cost). ``sizes`` fall."""
    room: dict[int, list[int]] = {}  # free tokens -> open bins
    free: list[int] = []  # keys of room, sorted
    used: list[int] = []
    where: list[int] = []
    top = lengths[-1]
    for n in sizes:
        k = bisect_left(free, n)
        if k < len(free):
            left = free[k]
            b = room[left].pop()
            if not room[left]:
                del room[left], free[k]
        else:
            b = len(used)
            used.append(0)
            least = min(top, factor * n)
            left = min((c for c in lengths if c >= n and c >= least), key=lambda c: price(c) / (c // n * n) if factor > 1 else price(c))
        where.append(b)
        used[b] += n
        left -= n
        if left:
            if left not in room:
                room[left] = []
                free.insert(bisect_left(free, left), left)
            room[left].append(b)
    capacity = [lengths[bisect_left(lengths, u)] for u in used]
    return where, capacity, sum(map(price, capacity))


def packed_group(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, price=cost) -> tuple[list[int], list[int]]:
    """The cheapest packing over all opening rules, for falling sizes."""
    tried = [best_fit(sizes.tolist(), lengths, f, price) for f in FACTORS]
    where, capacity, _ = min(tried, key=lambda x: x[2])
    return where, capacity


def n_tokens(text: Column) -> Column:
    """Words and one end token."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """A row a piece: its bin (numbered inside its group), the bin's capacity, and its place there."""
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    size = n_tokens(F.col("text")) if length is None else length
    groups = max(1, -(-docs.count() // GROUP))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("n"))
    rows = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "n", F.monotonically_increasing_id()), F.lit(groups)))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0)).cast("int")))
    rows = rows.select("pack_group", "doc_id", "n", piece.alias("piece"))
    rows = rows.select("pack_group", "doc_id", "piece", (F.col("piece").cast("long") * top).alias("token_start"), F.least(F.lit(top), F.col("n") - F.col("piece").cast("long") * top).cast("int").alias("n_tokens"))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        size = table["n_tokens"].to_numpy()
        where, capacity = packed_group(size, lengths)
        at = np.array(where)
        order = np.argsort(at, kind="stable")
        table, at, size = table.take(pa.array(order)), at[order], size[order]
        first = np.concatenate([[True], at[1:] != at[:-1]])
        begin = np.flatnonzero(first)
        upto = np.cumsum(size) - size
        run = np.cumsum(first) - 1
        slot = np.arange(len(at)) - begin[run]
        offset = upto - upto[begin][run]
        return pa.table(
            {
                "pack_group": table["pack_group"], "bin": pa.array(at.astype(np.int64)), "capacity": pa.array(np.array(capacity, dtype=np.int32)[at]), "slot": pa.array(slot.astype(np.int32)),
                "offset": pa.array(offset.astype(np.int32)), "doc_id": table["doc_id"], "piece": table["piece"], "token_start": table["token_start"], "n_tokens": table["n_tokens"],
            }
        )

    return rows.groupBy("pack_group").applyInArrow(packed, OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
