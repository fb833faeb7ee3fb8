"""Token-id files: documents in ascending doc_id order, ids in range-coded blocks.

A file is a sequence of runs. A run is a compressed table of its documents (id or null, number
of ids), a checksum, and one or more blocks that hold exactly these documents' ids; every block
starts from an empty model. Each task writes one file of its own range of documents and returns
an index row per run; totals per file give every run its place in the corpus. Runs are read
independently of each other, block by block.

Null texts are empty and have only the end id. Null doc_ids come first; rows with equal ids
stand together in no fixed order. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from feedloom.durable import scratch_path
from feedloom.llm.rangecoder import decode_block, encode_block
from feedloom.llm.storage import fresh_name, materialised, open_store
from feedloom.llm.tokens import encoder

#: Ids of a block, and of a run unless one document has more.
BLOCK_IDS = 1 << 20
MAGIC = b"IDRUN1\0\0"
_HEAD = struct.Struct("<8sQIII")

INDEX = "part int, run int, file string, offset bigint, length bigint, first bigint, n_ids bigint, n_docs bigint"
_INDEX = pa.schema(
    [
        ("part", pa.int32()),
        ("run", pa.int32()),
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("first", pa.int64()),
        ("n_ids", pa.int64()),
        ("n_docs", pa.int64()),
    ]
)
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
_DOCUMENTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def encode_run(docs: list[tuple[int | None, int]], ids: np.ndarray, vocabulary: int) -> bytes:
    """A run of documents (id, number of ids) and all their ids."""
    named = np.array([d is not None for d, _ in docs], np.uint8)
    names = np.array([d or 0 for d, _ in docs], "<i8")
    sizes = np.array([n for _, n in docs], "<u8")
    table = zlib.compress(named.tobytes() + names.tobytes() + sizes.tobytes(), 6)
    blocks = [encode_block(ids[i : i + BLOCK_IDS], vocabulary) for i in range(0, len(ids), BLOCK_IDS)]
    return _HEAD.pack(MAGIC, len(docs), len(table), zlib.crc32(table), len(blocks)) + table + b"".join(blocks)


def decode_run(data: bytes) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """Document ids, their sizes, and an iterator over the blocks' ids."""
    magic, n, size, crc, blocks = _HEAD.unpack_from(data)
    table = data[_HEAD.size : _HEAD.size + size]
    if magic != MAGIC or zlib.crc32(table) != crc:
        raise ValueError("damaged run")
    table = zlib.decompress(table)
    named, names = np.frombuffer(table, np.uint8, n), np.frombuffer(table, "<i8", n, n)
    sizes = np.frombuffer(table, "<u8", n, 9 * n).astype(np.int64)

    def ids() -> Iterator[np.ndarray]:
        at = _HEAD.size + size
        for _ in range(blocks):
            found, at = decode_block(data, at)
            yield found

    return [int(d) if k else None for d, k in zip(names, named)], sizes, ids()


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2) -> DataFrame:
    """Encode ``docs`` (doc_id, text) with the vocabulary at ``path`` into files in ``folder``;
    returns the index of runs."""
    # The row number parts documents that share an id, and makes the order the same everywhere.
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("at", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        encode, vocabulary = own.encode_many, max(own.tokenizer.get_vocab_size(), end_id + 1)
        end, part = int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        store, base = open_store(folder)
        name, out, offset, first, run = fresh_name("ids", part, ".bin"), None, 0, 0, 0
        held: list[tuple[int | None, int]] = []
        parts: list[bytes] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal out, offset, first, run, held, parts, n
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            data = encode_run(held, np.frombuffer(b"".join(parts), "<u4"), vocabulary)
            out.write(data)
            row = (part, run, name, offset, len(data), first, n, len(held))
            offset, first, run, held, parts, n = offset + len(data), first + n, run + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _INDEX)], schema=_INDEX)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids += end
                held.append((doc_id, len(ids) // 4))
                parts.append(ids)
                n += len(ids) // 4
                if n >= BLOCK_IDS:
                    yield close()
        if held:
            yield close()
        if out is not None:
            out.close()

    return ordered.select("doc_id", "text").mapInArrow(files, INDEX)


def read(index: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """Documents of the given runs, from the files; without ``ids`` only their checksums."""
    totals = index.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    runs = index.join(bases, "part").select("file", "offset", "length", (F.col("base") + F.col("first")).alias("start"))
    tasks = max(1, index.count())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{base}/{r['file']}") as source:
                    data = source.read_at(r["length"], r["offset"])
                names, sizes, blocks = decode_run(data)
                rows = list(_documents(names, sizes, blocks, r["start"], ids))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _DOCUMENTS)], schema=_DOCUMENTS)

    return runs.repartition(min(tasks, 1 << 16), "file", "offset").mapInArrow(decode, DOCUMENTS)


def _documents(names: list, sizes: np.ndarray, blocks: Iterator[np.ndarray], start: int, keep: bool) -> Iterator[tuple]:
    block = np.empty(0, np.int64)
    for name, size in zip(names, sizes.tolist()):
        crc, need, parts = 0, size, []
        while need:
            if not len(block):
                block = next(blocks)
            own = block[:need].astype("<u4").tobytes()
            block, need, crc = block[len(own) // 4 :], need - len(own) // 4, zlib.crc32(own, crc)
            if keep:
                parts.append(own)
        yield name, start, size, crc, b"".join(parts) if keep else None
        start += size


def round_trip(docs: DataFrame, path: str, end_id: int = 2, ids: bool = False) -> DataFrame:
    """Write the corpus and read it back: doc_id, start, n_tokens, ids_crc32, ids."""
    folder = scratch_path(docs.sparkSession, "id-files")
    index, _ = materialised(write(docs, folder, path, end_id), "id-index")
    return read(index, folder, ids)
