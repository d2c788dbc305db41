"""WARC archives, index first.

Writing: every page becomes one gzip member of a WARC/1.1 file; the task returns an index row for each
record (file, offset, length, url, digest, ...) and the index is a Parquet table beside the archives.
Reading: select from the index, then read only the chosen records, as sorted byte ranges of which near
neighbours are joined into one read.

Archive names hold the task's attempt, and only the index of finished attempts names them, so an executor
that is lost while it writes leaves at most a file that no index row refers to.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import shuffle_partitions, small_batches, written

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long, payload_bytes long"
RECORD = "page_id long, url string, payload binary, digest string, record_type string, refers_to long, payload_bytes long"
#: Smaller payloads are always written in full.
MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 256 << 20
READ_BYTES, READ_GAP = 8 << 20, 64 << 10
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in ddl.split(", "))])


def decide(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, payload_bytes, refers_to (null: response).

    Null html is an empty payload. Of equal payloads of at least min_bytes, rows with the smallest page_id are
    responses, the others refer to it. A null page_id is never the smallest; among null ids alone all are responses.
    The smallest id per digest is pre-aggregated; only (page_id, digest) rows meet it, never the payloads, and
    payloads are dealt by page_id, so that one very common payload does not gather in a task.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    light = full.where(F.col("payload_bytes") >= min_bytes).select("page_id", "digest")
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    again = light.join(first, "digest").where(F.expr("page_id is null or page_id > refers_to")).distinct()
    same = (F.col("f.page_id").eqNullSafe(F.col("a.page_id"))) & (F.col("f.digest") == F.col("a.digest"))
    return full.alias("f").join(again.alias("a"), same, "left").select("f.*", "a.refers_to")


def _header(fields: list[tuple[str, object]]) -> bytes:
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(v))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit holds the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = _header([
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("Payload-Length", len(payload)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ])
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def parse_record(member: bytes) -> dict:
    """The record of one gzip member; a response's digest is that of the bytes read, and must equal the header's."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda k: None if (x := fields.get(k, "none").strip("<>").rpartition(":")[2]) == "none" else int(x)
    if fields["WARC-Type"] == "response":
        found = hashlib.sha256(payload).hexdigest()
        if found != digest or len(payload) != int(fields["Payload-Length"]):
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    else:
        payload = None
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload, "digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload_bytes": int(fields["Payload-Length"])}


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html; other columns are ignored) into folder and returns the index.

    Runs one job. Null html is an empty payload, a null url leaves the header out. No pages: an empty index. A payload of any size is one
    record, which its task holds whole, as Spark holds the row; archives are closed after the record that passes archive_bytes.
    """
    small_batches(pages.sparkSession)
    schema = _schema(INDEX)

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, k, out, name, at = TaskContext.get(), 0, None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name = f"archive-{task.partitionId():05d}-{task.taskAttemptId()}-{k:04d}.warc.gz"
                    out, at, k = store.open_output_stream(f"{root}/{name}", compression=None), 0, k + 1
                data = record_bytes(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])
                out.write(data)
                rows.append({"file": name, "offset": at, "length": len(data), "record_type": "response" if r["refers_to"] is None else "revisit"} | {c: r[c] for c in ("page_id", "url", "digest", "refers_to", "payload_bytes")})
                at += len(data)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if out is not None:
            out.close()

    return written(decide(pages).mapInArrow(put, INDEX), "warc-index")


def ranges(rows: Iterable[dict], gap: int = READ_GAP, most: int = READ_BYTES) -> Iterator[list[dict]]:
    """Rows sorted by (file, offset), in runs that one read covers: same file, gaps up to gap, most bytes a read."""
    run: list[dict] = []
    for r in rows:
        if run and (r["file"] != run[0]["file"] or r["offset"] - (run[-1]["offset"] + run[-1]["length"]) > gap or r["offset"] + r["length"] - run[0]["offset"] > most):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_records(selected: DataFrame, folder: str, block: int = 32 << 20) -> DataFrame:
    """The records of the selected index rows. Work is dealt by (file, block), so a large archive is read by many tasks."""
    schema = _schema(RECORD)

    def get(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        name, src = None, None
        for run in ranges(r for b in batches for r in b.to_pylist()):
            if run[0]["file"] != name:
                name = run[0]["file"]
                src = store.open_input_file(f"{root}/{name}")
            start = run[0]["offset"]
            data = src.read_at(run[-1]["offset"] + run[-1]["length"] - start, start)
            rows = [parse_record(data[r["offset"] - start : r["offset"] - start + r["length"]]) for r in run]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    where = selected.select("file", "offset", "length", F.floor(F.col("offset") / block).alias("block"))
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(shuffle_partitions(selected.sparkSession), -(-size // block))  # by the bytes to read: index rows say little of them
    return where.repartition(tasks, "file", "block").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(get, RECORD)
