"""Exact removal of repeated byte strings through a sparse suffix array.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere (in any text, overlaps count) is marked.

Sorting the suffixes at all bytes would move many times the input. A window of ``LENGTH`` bytes picks one anchor: the
leftmost of its ``GRAM``-byte strings with the least hash. Equal windows pick the same place, so suffixes at anchors
(about 1.2 a hundred bytes) hold every repeat. Steps:

1. One pass emits a row an anchor: its leading token (hash of its first ``GRAM`` bytes), a hash of all the context a
   window through it can have (``LEFT`` bytes before, ``LENGTH`` after), text key and place.
2. The rows are range-partitioned by sampled splitters over (token, context, key, place), so a token or context of any
   frequency spreads over as many buckets as it fills. In a bucket, anchors whose context stands twice are repeated
   with all their context: done. Others whose token stands twice stay open, with one row for each repeated context of
   the token. Tokens that touch a bucket's border may go on in the next one and stay open too: the next step compares
   them across the border.
3. Open anchors (the ends of repeats) get their bytes from the texts. Buckets of whole tokens are sorted by multikey
   quicksort over eight-byte symbols; common prefixes of neighbours give, for every offset, the runs of suffixes that
   agree on the part of the window after the anchor, and the hash of the part before it splits those runs.
4. Covered intervals meet their texts.

In a periodic stretch (one letter again and again, say) every window stands again a period on. The stretch is one interval, done
in step 1; only the windows of its first period have anchors.

Defined results: texts of any length come by pieces; columns of the input may have any names; null texts are empty; texts under ``LENGTH`` bytes keep everything; rows without an id are known by
their text; repeated rows are repeats of each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import textkit as tk
from quarrykit.llm.storage import written

LENGTH = 200
GRAM = 32
LEFT = LENGTH - GRAM
PIECE = 1 << 20
_PLACE = np.uint64(PIECE - 1)
BUCKET = 1 << 15


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i that has them."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _mismatches(data: np.ndarray, lag: int) -> np.ndarray:
    return np.flatnonzero(data[:-lag] != data[lag:])


def _runs_of_gaps(place: np.ndarray) -> np.ndarray:
    """The first of each run of even gaps between ``place`` that spans ``LENGTH`` bytes."""
    gap = np.diff(place)
    if not len(gap):
        return gap
    new = np.flatnonzero(np.concatenate([[True], gap[1:] != gap[:-1]]))
    return new[np.diff(np.append(new, len(gap))) * gap[new] >= LENGTH]


def _evenly_spaced(place: np.ndarray, begin: np.ndarray) -> list[int]:
    """The texts that may have periodic stretches; a run that goes over texts by chance costs a look at its first."""
    runs = _runs_of_gaps(place)
    return np.unique(np.concatenate([np.searchsorted(begin, place[runs + k], side="right") - 1 for k in (0, 1)])).tolist() if len(runs) else []


def periodic(data: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, end, period) of stretches of one text in which every byte equals the one a period on, ``LENGTH`` and a period
    long at least. Such a stretch has anchors a period apart, so only even distances between ``place`` are looked at."""
    out: list[tuple[int, int, int]] = []
    known: dict[int, np.ndarray] = {}
    for first in _runs_of_gaps(place).tolist():
        at, lag = int(place[first]), int(place[first + 1] - place[first])
        if lag >= LENGTH or out and at < out[-1][1] - LENGTH:
            continue
        if lag not in known:
            known = {lag: _mismatches(data, lag)}
        k = int(np.searchsorted(known[lag], at))
        begin = int(known[lag][k - 1]) + 1 if k else 0
        end = (int(known[lag][k]) if k < len(known[lag]) else len(data) - lag) + lag
        if end - begin >= LENGTH + lag:
            out.append((begin, end, lag))
    return out


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of (text index, place, token, context, end) of the anchors of texts. Texts come by pieces of ``PIECE`` bytes, so the
    arrays are small however long a text is. In a periodic stretch each window stands again a period on: the stretch is a row with
    its ``end`` (that of anchors is 0), and only the windows of its first period pick anchors, which stand for the others."""
    held: list[int] = []
    total = 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if len(t) > PIECE:
            yield from _long_anchors(i, t)
            continue
        if total + len(t) > PIECE:
            yield _anchors(held, [texts[k] for k in held])
            held, total = [], 0
        held.append(i)
        total += len(t)
    if held:
        yield _anchors(held, [texts[k] for k in held])


def _long_anchors(index: int, text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces with all the context of their windows' anchors. Places rise with windows, so a place that the piece before had
    too is one that isn't beyond its last."""
    upto = -1
    step = PIECE - 2 * LENGTH
    for a in range(0, len(text) - LENGTH + 1, step):
        b = min(a + step, len(text) - LENGTH + 1)  # windows that start in a..b
        low = max(a - LEFT, 0)
        _, place, token, context, end = _anchors([index], [text[low : b + LEFT + LENGTH]], a - low, b - low)
        place, end = place + low, np.where(end > 0, end + low, 0)
        new = (place > upto) | (end > 0)
        if (end == 0).any():
            upto = max(upto, int(place[end == 0].max()))
        yield np.full(int(new.sum()), index), place[new], token[new], context[new], end[new]


def _anchors(index: list[int], texts: list[bytes], first: int = 0, last: int | None = None) -> tuple[np.ndarray, ...]:
    """Of the windows that start in ``first`` to ``last`` of the texts' bytes together."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(size)])
    sums = tk.prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    token = tk.span_hashes(sums, at, at + GRAM)
    start = np.arange(first, len(data) - LENGTH + 1 if last is None else last)
    part = token[first : len(start) + first + LEFT]
    ranked = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
    least = (_sliding_least(ranked, LEFT + 1) & _PLACE).astype(np.int64) + first
    inside = start + LENGTH <= begin[np.searchsorted(begin, start, side="right")]
    place = np.unique(least[inside])
    stretches = []
    for k in _evenly_spaced(place, begin):
        own = place[np.searchsorted(place, begin[k]) : np.searchsorted(place, begin[k + 1])] - begin[k]
        stretches += [(x + int(begin[k]), y + int(begin[k]), lag) for x, y, lag in periodic(data[begin[k] : begin[k + 1]], own)]
    if stretches:
        for x, y, lag in stretches:
            inside[max(x + lag - first, 0) : max(y - LENGTH + 1 - first, 0)] = False
        place = np.unique(least[inside])
    owner = np.searchsorted(begin, place, side="right") - 1
    lo, hi = np.maximum(place - LEFT, begin[owner]), np.minimum(place + LENGTH, begin[owner + 1])
    with np.errstate(over="ignore"):
        context = tk.mix(tk.span_hashes(sums, lo, place) * np.uint64(3) + tk.span_hashes(sums, place, hi))
    low, high = (np.array([s[k] for s in stretches], dtype=np.int64) for k in (0, 1))
    whose = np.searchsorted(begin, low, side="right") - 1
    none = np.zeros(len(low), dtype=np.uint64)
    return (
        np.array(index)[np.concatenate([owner, whose])],
        np.concatenate([place - begin[owner], low - begin[whose]]),
        np.concatenate([token[place], tk.mix(low.astype(np.uint64))]),  # stretches are dealt evenly
        np.concatenate([context, none]),
        np.concatenate([np.zeros(len(place), dtype=np.int64), high - begin[whose]]),
    )


ANCHORS = "token long, context long, id long, chk int, place long, end long"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ANCHORS.split(", ")]
    for b in batches:
        key, check = b.column(0).to_numpy(), b.column(1).to_numpy()
        for first, held in tk.chunks(b.column(2).cast(pa.binary()).to_pylist()):
            for i, place, token, context, end in anchors(held):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token.view(np.int64), context.view(np.int64), key[first + i], check[first + i], place, end)], names=names)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run of each, length of each one's run) of equal neighbours."""
    new = np.concatenate([[True], x[1:] != x[:-1]])
    run = np.cumsum(new) - 1
    return run, np.bincount(run)[run]


def _judged(token, context, border: np.ndarray):
    """For rows sorted by token and context: repeated with all context; open; ``border``: tokens seen in part only."""
    t_run, t_size = _runs(token)
    pair, p_size = _runs_of_pairs(token, context)
    full = p_size > 1
    first = np.concatenate([[True], pair[1:] != pair[:-1]])
    classes = np.bincount(t_run, weights=first)[t_run]
    waits = (classes > 1) | border[t_run]
    return full, waits & (~full | first)


def _runs_of_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    run = np.cumsum(new) - 1
    return run, np.bincount(run)[run]


def _judged_batch(kinds: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*kinds)], names=["kind", "token", "id", "chk", "lo", "hi"])


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a bucket -> kind 0: an interval; kind 1: an open anchor. A token's rows are judged together; the
    first and the last token of the bucket may go on beyond it."""
    held, first = None, True

    def out(rows, last: bool):
        nonlocal first
        direct = rows[5] > 0
        done = [x[direct] for x in rows]
        token, context, key, check, place, _ = (x[~direct] for x in rows)
        kinds = [[np.zeros(len(done[0]), dtype=np.int32), done[0], done[2], done[3], done[4], done[5]]]
        if not len(token):
            return _judged_batch(kinds)
        run = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
        border = np.zeros(run[-1] + 1, dtype=bool)
        border[0] |= first
        border[-1] |= last
        first = False
        full, waits = _judged(token, context, border)
        for kind, m in ((0, full), (1, waits)):
            p = place[m]
            lo, hi = (np.maximum(p - LEFT, 0), p + LENGTH) if kind == 0 else (p, p)
            kinds.append([np.full(len(p), kind, dtype=np.int32), token[m], key[m], check[m], lo, hi])
        return _judged_batch(kinds)

    for b in batches:
        if not b.num_rows:
            continue
        rows = [c.to_numpy() for c in b.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last token waits for more rows
        held = [x[cut:] for x in rows]
        if cut:
            yield out([x[:cut] for x in rows], False)
    if held is not None:
        yield out(held, True)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their open anchors -> an anchor a row: bytes after it, bytes before it."""
    for b in batches:
        out: list[list] = [[], [], [], [], [], []]
        for key, check, text, tokens, places in zip(*(c.to_pylist() for c in b.columns)):
            for t, p in zip(tokens, places):
                for x, v in zip(out, (t, key, check, p, text[p : p + LENGTH], text[max(0, p - LEFT) : p])):
                    x.append(v)
            if len(out[0]) > 50_000:
                yield _context_batch(out)
                out = [[], [], [], [], [], []]
        yield _context_batch(out)


def _context_batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["token", "id", "chk", "place", "after", "before"])


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of symbols: by the first symbol, ties by the next one, and so on, among the tied only."""
    order = np.argsort(words[:, 0], kind="stable")
    group = np.cumsum(np.concatenate([[True], words[order[1:], 0] != words[order[:-1], 0]]))
    for k in range(1, words.shape[1]):
        alone = np.concatenate([[True], group[1:] != group[:-1]]) & np.concatenate([group[1:] != group[:-1], [True]])
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        rows = order[tied]
        again = np.lexsort((words[rows, k], group[tied]))
        order[tied] = rows[again]
        new = np.concatenate([[True], (group[1:] != group[:-1])])
        new[1:] |= (words[order[1:], k] != words[order[:-1], k]) & ~(alone[1:] | alone[:-1])
        group = np.cumsum(new)
    return order


def _padded(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(v) for v in values])
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), dtype=np.uint8).reshape(len(values), width), n


def repeated_around(after: list[bytes], before: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the largest and the smallest offset d such that the window from d bytes before it stands around
    another anchor too (-1 where there is none)."""
    right, r_len = _padded(after, LENGTH)
    left, l_len = _padded([v[::-1] for v in before], LEFT)
    order = multikey_order(right.view(">u8").astype(np.uint64))
    right, left, r_len, l_len = right[order], left[order], r_len[order], l_len[order]
    differs = right[1:] != right[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH)
    common = np.minimum(common, np.minimum(r_len[1:], r_len[:-1]))
    most, least = np.full(len(order), -1), np.full(len(order), -1)
    code = np.zeros(len(order), dtype=np.uint64)
    for d in range(LEFT + 1):
        if d:
            with np.errstate(over="ignore"):
                code = tk.mix(code + left[:, d - 1] + np.uint64(d))
        can = (l_len >= d) & (r_len >= LENGTH - d)
        run = np.concatenate([[0], np.cumsum(common < LENGTH - d)])
        size = np.bincount(run)[run]
        at = np.flatnonzero(can & (size > 1))
        if not len(at):
            continue
        with np.errstate(over="ignore"):
            key = tk.mix(code[at] + tk.mix(run[at].astype(np.uint64)))
        by = np.argsort(key)
        k = key[by]
        same = k[1:] == k[:-1]
        hit = at[by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        most[hit] = d
        least[hit] = np.where(least[hit] < 0, d, least[hit])
    back = np.empty((2, len(order)), dtype=np.int64)
    back[:, order] = most, least
    return back[0], back[1]


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out(table: pa.Table):
        most, least = repeated_around(table["after"].to_pylist(), table["before"].to_pylist())
        hit = most >= 0
        p = table["place"].to_numpy()[hit]
        cols = [table["id"].to_numpy()[hit], table["chk"].to_numpy()[hit], p - most[hit], p - least[hit] + LENGTH]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "chk", "lo", "hi"])

    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= BUCKET:
            table = pa.Table.from_batches(held)
            token = table["token"].to_numpy()
            cut = int(np.searchsorted(token, token[-1]))
            if cut:
                yield out(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows = table.num_rows - cut
    if held:
        yield out(pa.Table.from_batches(held))


def keyed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``_id`` and ``_chk``, which tell rows apart that differ in id or text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.xxhash64(body))).withColumn("_chk", F.hash(body))


def _named(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names of its own, so that none clashes with a name used here, and the new name of each old one."""
    names = [f"_in{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def repeated_intervals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_id, _chk, spans`` (array of lo, hi; ends may pass the text's end) of the texts of ``keyed`` docs that repeat."""
    body = docs.select("_id", "_chk", F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = body.where(F.octet_length("t") >= LENGTH).mapInArrow(_anchor_rows, ANCHORS)
    ranged = rows.repartitionByRange("token", "context", "id", "chk", "place").sortWithinPartitions("token", "context", "id", "chk", "place")
    judged = written(ranged.mapInArrow(_bucket, "kind int, token long, id long, chk int, lo long, hi long"), "anchors")
    waiting = judged.where("kind = 1").distinct().groupBy("id", "chk").agg(F.collect_list(F.struct("token", "lo")).alias("w"))
    waiting = waiting.select("id", "chk", F.transform("w", lambda x: x["token"]).alias("tokens"), F.transform("w", lambda x: x["lo"]).alias("places"))
    unique = body.select("_id", "_chk", F.col("t").cast("binary").alias("t"))
    texts = unique.join(waiting, (unique._id == waiting.id) & (unique._chk == waiting.chk)).select("id", waiting.chk, "t", "tokens", "places")
    around = texts.mapInArrow(_contexts, "token long, id long, chk int, place long, after binary, before binary")
    found = around.repartition("token").sortWithinPartitions("token").mapInArrow(_sorted_buckets, "id long, chk int, lo long, hi long")
    spans = judged.where("kind = 0").select("id", "chk", "lo", "hi").unionByName(found)
    return spans.groupBy(F.col("id").alias("_id"), F.col("chk").alias("_chk")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def merged(lo: list[int], hi: list[int], n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(lo, hi)):
        b = min(b, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _cut(text: bytes, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    if not spans:
        return text, []
    runs = merged([s["lo"] for s in spans], [s["hi"] for s in spans], len(text))
    edges = [0, *(x for r in runs for x in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), runs


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for key, text, spans in zip(*(c.to_pylist() for c in b.columns)):
            kept, runs = _cut(text, spans)
            for x, v in zip(out, (key, len(text), sum(hi - lo for lo, hi in runs), len(runs), hashlib.sha256(kept).hexdigest())):
                x.append(v)
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    known = keyed(docs, id_col, text)
    return known.join(repeated_intervals(known, text), ["_id", "_chk"], "left")


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row."""
    own, name = _named(docs.select(id_col, text))
    rows = _with_spans(own, name[id_col], name[text])
    return rows.select(F.col(name[id_col]).cast("long"), F.coalesce(F.col(name[text]), F.lit("")).cast("binary"), "spans").mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of ``text``; half a character at a cut goes too. Null texts stay null."""

    @F.pandas_udf("string")
    def cut(t, spans):
        import pandas as pd

        return pd.Series([None if x is None else _cut(x.encode(), None if s is None else list(s))[0].decode("utf-8", "ignore") for x, s in zip(t, spans)], dtype=object)

    own, name = _named(docs)
    rows, body = _with_spans(own, name[id_col], name[text]), name[text]
    rows = rows.withColumn(body, F.when(F.col("spans").isNull(), F.col(body)).otherwise(cut(F.col(body), F.col("spans"))))
    return rows.select(*own.columns).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
