"""WARC archives with an index that is read first.

Writing: one gzip member per record; each task writes files of its own and returns an index row
(file, offset, length, URL, digest) per record. Reading: selected index rows are sorted by file
and offset, neighbouring ranges are read in one go, and every record's payload digest is
checked. Of records with equal payloads of at least ``smallest`` bytes the one with the largest
page_id is a response, the others are revisits of it; smaller ones are responses.

A null payload is empty. A null page_id is always a response and never referred to. Rows that
repeat the largest page_id of their payload are all responses. A null or blank URL is written as
``urn:none`` and read as null; control characters and blanks in URLs are percent-encoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from feedloom.durable import scratch_path
from feedloom.llm.storage import fresh_name, materialised, open_store

#: Bytes of an archive file, of one coalesced read, and of a gap that is read along.
FILE_BYTES, READ_BYTES, GAP_BYTES = 1 << 28, 1 << 23, 1 << 16
#: Archive bytes of a reading task, as far as the number of tasks allows.
TASK_BYTES, MOST_TASKS = 1 << 24, 1 << 16

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")

INDEX = (
    "file string, offset bigint, length bigint, url string, payload_digest string, payload_bytes bigint, "
    "page_id bigint, record_type string, refers_to bigint"
)
_INDEX = pa.schema(
    [
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("url", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)
RECORDS = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str, str]:
    """A record's uncompressed bytes, its type and its payload digest."""
    digest = digest_of(payload)
    kind = "response" if refers_to is None else "revisit"
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", (url or "").strip()) or "urn:none"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _name(page_id, digest) if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", kind, digest


def parse(data: bytes) -> tuple[dict[str, str], bytes | None, int]:
    """A record's fields, its payload (None for a revisit) and the full payload's size."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or f"sha1:{digest_of(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError("damaged record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "revisit":
        return fields, None, size
    if len(payload) != size or f"sha1:{digest_of(payload)}" != fields["WARC-Payload-Digest"]:
        raise ValueError("damaged payload")
    return fields, payload, size


def with_references(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: the page each payload revisits, if any."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("same", F.sha2("payload", 256))
    newest = (
        rows.where(F.octet_length("payload") >= smallest)
        .groupBy("same")
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("same", "refers_to")
    )
    # Only identifiers travel to find the references; payloads then meet theirs by page.
    older = rows.select("page_id", "same").distinct().join(newest, "same").where("page_id < refers_to")
    return rows.join(older, ["page_id", "same"], "left").select("page_id", "url", "payload", "refers_to")


def write(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``with_references`` rows as archives in ``folder``; returns the index."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        part, name, out, at = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            index = []
            for page_id, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = fresh_name("pages", part, ".warc.gz"), 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data, kind, digest = record(page_id, url, payload, refers_to, date)
                member = gzip.compress(data, compresslevel=4, mtime=0)
                out.write(member)
                index.append((name, at, len(member), url, digest, len(payload), page_id, kind, refers_to))
                at += len(member)
            columns = zip(*index) if index else [[]] * len(_INDEX)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _INDEX)], schema=_INDEX)
        if out is not None:
            out.close()

    return rows.mapInArrow(archive, INDEX)


def ranges(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Index rows sorted by file and offset, as runs to read in one go."""
    run: list[dict] = []
    for row in rows:
        if run:
            first, last = run[0], run[-1]
            end = row["offset"] + row["length"]
            gap = row["offset"] - last["offset"] - last["length"]
            if row["file"] != first["file"] or gap > GAP_BYTES or end - first["offset"] > READ_BYTES:
                yield run
                run = []
        run.append(row)
    if run:
        yield run


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the given index rows; without ``payloads`` they are checked but not returned."""
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    tasks = min(MOST_TASKS, max(1, -(-size // TASK_BYTES)))
    dealt = (
        index.select("file", "offset", "length")
        .repartition(tasks, F.col("file"), F.floor(F.col("offset") / (TASK_BYTES // 8)))
        .sortWithinPartitions("file", "offset")
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        name, source, rows, held = None, None, [], 0
        for run in ranges(r for b in batches for r in b.to_pylist()):
            if run[0]["file"] != name:
                if source is not None:
                    source.close()
                name = run[0]["file"]
                source = store.open_input_file(f"{base}/{name}")
            start = run[0]["offset"]
            data = source.read_at(run[-1]["offset"] + run[-1]["length"] - start, start)
            for r in run:
                at = r["offset"] - start
                fields, payload, n = parse(zlib.decompress(data[at : at + r["length"]], 31))
                page, refers, url = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID"), fields["WARC-Target-URI"]
                rows.append(
                    (
                        None if page is None else int(page),
                        None if url == "urn:none" else url,
                        payload if payloads else None,
                        n,
                        fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                        fields["WARC-Type"],
                        None if refers is None else int(refers),
                    )
                )
                held += len(payload or b"") if payloads else 256
                if held >= READ_BYTES:
                    yield _records(rows)
                    rows, held = [], 0
        if source is not None:
            source.close()
        if rows:
            yield _records(rows)

    return dealt.mapInArrow(fetch, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _RECORDS)], schema=_RECORDS)


def archive_pages(pages: DataFrame, smallest: int = 0) -> tuple[DataFrame, str]:
    """Write ``pages`` (page_id, url, html); the index table and the archives' folder."""
    folder = scratch_path(pages.sparkSession, "archives")
    index, _ = materialised(write(with_references(pages, smallest), folder), "archive-index")
    return index, folder
