"""WARC archives as a chunked record table.

A record is a run of rows (record_id, chunk_no) of at most ``CHUNK`` payload bytes each; chunk 0 has the header blocks
too (that of the record, and that of the HTTP response, as ``application/http`` asks), and the last row closes the record. Headers and data,
concatenated, are the record's bytes in a WARC/1.1 file.
Each row carries the SHA-1 of the payload up to and with it, so that a reader checks a record as it streams and no step
holds a whole record: chunks are cut on the JVM side, and Python sees rows of ``CHUNK`` bytes.

Records with equal payloads of ``REVISIT_LEAST`` bytes or more: the one with the largest page id is the response, the
others are revisit records that name it and store no payload. Which digest has copies is found from ids and digests
alone, dealt with salts, so a payload that a third of the pages share loads no single task.

Defined results: null payloads are empty; rows without a page id are responses, and may be revisited only by none;
a record's id names page, payload and target, so only repeated rows share one, being one record that stands twice: all those with the
largest id are responses; payloads of any length are chunks; columns of the input that clash with names here don't matter, as only
id, url and payload are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.graph import with_group
from quarrykit.llm.storage import written

CHUNK = 1 << 18
REVISIT_LEAST = 1000
RECORDS = "record_id string, chunk_no int, last boolean, header binary, data binary, sha1 string"


def _crlf(*lines) -> Column:
    return F.concat_ws("\r\n", *lines)


def records(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", date: str | None = None) -> DataFrame:
    """The chunked record table of ``pages``; ``date`` (ISO 8601, UTC) is that of all records, now by default."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"))
    page = page.withColumn("sha", F.sha1("body")).withColumn("bytes", F.octet_length("body").cast("long"))
    # narrow: ids and digests of pages that may have copies
    large = page.where(f"bytes >= {REVISIT_LEAST} and page_id is not null").select("sha", "page_id", F.struct("page_id", F.lower(F.hex(F.xxhash64("url"))).alias("target")).alias("last"))
    copies = with_group(large, ["sha"], "page_id", winner=(F.max, "last")).where("group_rows > 1 and page_id < winner.page_id")
    winner = F.concat(F.lit("urn:page:"), F.col("winner.page_id").cast("string"), F.lit(":"), F.col("sha"), F.lit(":"), F.col("winner.target"))
    copies = copies.select("page_id", "sha", F.col("winner.page_id").alias("refers_to"), winner.alias("refers_to_id")).distinct()
    told = page.join(copies, ["page_id", "sha"], "left")
    revisit = F.col("refers_to").isNotNull()
    kept = F.when(revisit, F.lit(b"")).otherwise(F.col("body"))
    page_id = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "_")
    uid = F.concat(F.lit("urn:page:"), page_id, F.lit(":"), F.col("sha"), F.lit(":"), F.lower(F.hex(F.xxhash64("url"))))
    http = _crlf(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string")), F.lit("\r\n"))
    header = _crlf(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <"), uid, F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha")),
        F.concat(F.lit("X-Page-ID: "), page_id),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page: "), F.col("refers_to").cast("string"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), F.col("refers_to_id"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(kept)).cast("string")),
        F.concat(F.lit("\r\n"), http),
    )
    # the table's key tells repeated rows apart
    key = F.concat(uid, F.lit("#"), F.monotonically_increasing_id().cast("string"))
    rows = told.select(key.alias("record_id"), header.cast("binary").alias("header"), kept.alias("kept"))
    n = F.greatest(F.ceil(F.octet_length("kept") / CHUNK).cast("int"), F.lit(1))
    rows = rows.select("record_id", "header", "kept", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    data = F.substr("kept", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK))
    rows = rows.select("record_id", "chunk_no", (F.col("chunk_no") == F.col("n") - 1).alias("last"), F.when(F.col("chunk_no") == 0, F.col("header")).alias("header"), data.alias("data"))
    return rows.mapInArrow(_with_digests, RECORDS)


def _with_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A record's rows follow each other; the digest runs on over rows and batches."""
    running = hashlib.sha1()
    for b in batches:
        sums = []
        for no, data in zip(b.column(1).to_pylist(), b.column(4)):
            if no == 0:
                running = hashlib.sha1()
            running.update(data.as_buffer())
            sums.append(running.hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums)], names=["record_id", "chunk_no", "last", "header", "data", "sha1"])


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8").split("\r\n\r\n", 1)[0].split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC header")
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of record and chunk -> a row a record, its payload hashed chunk by chunk."""
    fields, running, length, http = None, None, 0, 0
    for b in batches:
        out = []
        for record, no, last, header, data, told in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4), b.column(5).to_pylist()):
            if no == 0:
                fields, running, length = _fields(header), hashlib.sha1(), 0
                http = len(header) - header.index(b"\r\n\r\n") - 4
            buffer = data.as_buffer()
            running.update(buffer)
            length += buffer.size
            if running.hexdigest() != told:
                raise ValueError(f"{record}: chunk {no} does not match its digest")
            if last:
                revisit = fields["WARC-Type"] == "revisit"
                if http + length != int(fields["Content-Length"]):
                    raise ValueError(f"{record}: {http + length} bytes instead of {fields['Content-Length']}")
                if not revisit and f"sha1:{running.hexdigest()}" != fields["WARC-Payload-Digest"]:
                    raise ValueError(f"{record}: payload digest differs")
                page = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
                out.append(
                    {
                        "page_id": None if fields["X-Page-ID"] == "none" else int(fields["X-Page-ID"]),
                        "url": fields.get("WARC-Target-URI", ""),
                        "payload_bytes": int(fields["X-Payload-Length"]) if revisit else length,
                        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else running.hexdigest(),
                        "record_type": fields["WARC-Type"],
                        "refers_to": int(fields["X-Refers-To-Page"]) if revisit else None,
                    }
                )
        yield pa.RecordBatch.from_pylist(out, schema=_READ)


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_back(table: DataFrame) -> DataFrame:
    """A row a record of a stored table. One-row records are read where they lie; the rows of the others come together
    by record and stream through in order."""
    shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    whole = F.col("last") & (F.col("chunk_no") == 0)
    parts = table.where(~whole).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return table.where(whole).mapInArrow(_read, shape).unionByName(parts.mapInArrow(_read, shape))


def export(table: DataFrame, folder: str) -> None:
    """``.warc`` files, one a partition and named by it, into a folder that executors share and mount. A task that runs again,
    or twice at a time, puts the same records in the place of its file, so none stands twice."""

    def files(batches):
        import os
        import uuid

        from pyspark import TaskContext

        path = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.warc")
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(own, "wb") as out:
            for b in batches:
                for last, header, data in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                    out.write(header or b"")
                    out.write(data.as_buffer())
                    if last:
                        out.write(b"\r\n\r\n")
        os.replace(own, path)
        yield pa.RecordBatch.from_pydict({"path": [path]})

    table.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(files, "path string").count()


def read_file(stream, size: int = 1 << 16) -> Iterator[dict]:
    """Header fields, payload length and SHA-1 of each record of a ``.warc`` stream, ``size`` bytes at a time."""

    def block() -> list[bytes]:
        lines = []
        while (line := stream.readline()) not in (b"\r\n", b""):
            lines.append(line)
        return lines

    while line := stream.readline():
        if line.strip() == b"":
            continue
        fields = _fields(b"".join([line, *block()]))
        http = sum(map(len, block())) + 2  # with the blank line that ends it
        length = left = int(fields["Content-Length"]) - http
        running = hashlib.sha1()
        while left:
            data = stream.read(min(size, left))
            if not data:
                raise EOFError("record ends early")
            running.update(data)
            left -= len(data)
        yield fields | {"length": length, "sha1": running.hexdigest()}


def query(spark, sf_dir: str) -> DataFrame:
    archive = written(records(spark.read.parquet(f"{sf_dir}/pages.parquet")), "warc")
    return read_back(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) d from pages),
w as (select *, max(page_id) over (partition by d) m from p)
select page_id, n::bigint payload_bytes, d payload_digest, case when n >= 1000 and page_id < m then 'revisit' else 'response' end record_type,
  case when n >= 1000 and page_id < m then m end refers_to from w
"""
