"""Exact deduplication with streaming state.

Each text, white space runs made one space, gets its SHA-256, and its bytes go to a content
file in the shared folder (once per file and digest). A structured stream over the narrow
records keeps, per digest and without expiry, the smallest identifier, its content locator and
the number of rows, in a disk-backed state store. Rows of one task are combined before the
shuffle, so a digest that a third of all rows share costs one row per task. Every record that
hits a digest with another locator is then checked: both contents are read and compared byte by
byte, and records that differ are grouped by their bytes instead.

A null text counts as empty. Of equal texts the row with the smallest doc_id stays, rows with a
null doc_id last; of repeated rows with the same doc_id one stays.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.taskcontext import TaskContext

from feedloom.durable import scratch_path
from feedloom.llm.storage import forget, fresh_name, materialised, open_store

#: Compressed bytes of a content file.
CONTENT_BYTES = 64 << 20
#: Landed files read by one micro-batch.
FILES_PER_BATCH = 256

RECORDS = "row_id bigint, doc_id bigint, sha256 binary, file string, offset bigint, size int"
_RECORDS = pa.schema(
    [
        ("row_id", pa.int64()),
        ("doc_id", pa.int64()),
        ("sha256", pa.binary()),
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("size", pa.int32()),
    ]
)
_SPACE = b"\t\n\x0b\x0c\r "
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with each run of ASCII white space replaced by one space."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    core = b" ".join(raw.split())
    if not core:
        return raw[:1] and b" "
    return b" " * (raw[0] in _SPACE) + core + b" " * (raw[-1] in _SPACE)


def land(docs: DataFrame, folder: str) -> DataFrame:
    """Records of ``docs`` (doc_id, text), with the contents written to files in ``folder``."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        squeeze, expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        name, content, known = fresh_name("content", part, ".zst"), bytearray(), {}

        def place(digest: bytes, text: bytes) -> tuple[int, int]:
            for offset, size in known.get(digest, ()):
                if expand.decompress(bytes(content[offset : offset + size])) == text:
                    return offset, size
            packed = squeeze.compress(text)
            at = (len(content), len(packed))
            content.extend(packed)
            known.setdefault(digest, []).append(at)
            return at

        def close() -> None:
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(bytes(content))

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = normalised(text)
                digest = hashlib.sha256(text).digest()
                rows.append(((part << 36) | number, doc_id, digest, name, *place(digest, text)))
                number += 1
                if len(content) >= CONTENT_BYTES:
                    close()
                    name, content, known = fresh_name("content", part, ".zst"), bytearray(), {}
            columns = zip(*rows) if rows else [[]] * len(_RECORDS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _RECORDS)], schema=_RECORDS)
        if content:
            close()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(records, RECORDS)


def keep_first(spark: SparkSession, records: str, digest_bytes: int = 32) -> tuple[DataFrame, list[str]]:
    """Per digest of the landed records the first identifier, its locator and the row count.

    Runs the stream until all landed files are read; returns the table and the folders to
    forget after use.
    """
    session = spark.newSession()
    for setting in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(setting, spark.conf.get(setting))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # There may be many small stores; each would set megabytes of disk aside for its logs.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    # Stores of an ended stream give their disk back at the next maintenance.
    session.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "5s")
    updates, progress = scratch_path(spark, "first-seen"), scratch_path(spark, "first-seen-progress")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    first = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "row_id", "file", "offset", "size"))
    stream = (
        session.readStream.schema(RECORDS)
        .option("maxFilesPerTrigger", FILES_PER_BATCH)
        .parquet(records)
        .groupBy(F.substring("sha256", 1, digest_bytes).alias("digest"))
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    state = (
        "digest binary, n bigint, "
        "first struct<unnamed:boolean,doc_id:bigint,row_id:bigint,file:string,offset:bigint,size:int>"
    )
    # Later updates of a digest only count up and only find smaller identifiers.
    seen = spark.read.schema(state + ", batch int").parquet(updates) if _written(spark, updates) else spark.createDataFrame([], state)
    return seen.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n")), [updates, progress]


def _written(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class _Contents:
    """Reads contents by locator, with a few files open and the last texts at hand."""

    def __init__(self, folder: str):
        self.store, self.base = open_store(folder)
        self.files: OrderedDict = OrderedDict()
        self.last: tuple = ()
        self.expand = zstandard.ZstdDecompressor()

    def read(self, name: str, offset: int, size: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= 16:
                self.files.popitem(last=False)[1].close()
            self.files[name] = self.store.open_input_file(f"{self.base}/{name}")
        self.files.move_to_end(name)
        return self.expand.decompress(self.files[name].read_at(size, offset))


def differing(hits: DataFrame, folder: str) -> DataFrame:
    """Of pairs of locators, those (file, offset) whose contents differ."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents, held, text = _Contents(folder), None, b""
        for batch in batches:
            files, offsets = [], []
            for r in batch.to_pylist():
                if (at := (r["first_file"], r["first_offset"], r["first_size"])) != held:
                    held, text = at, contents.read(*at)
                if contents.read(r["file"], r["offset"], r["size"]) != text:
                    files.append(r["file"])
                    offsets.append(r["offset"])
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(offsets, pa.int64())], ["file", "offset"])

    return hits.mapInArrow(compare, "file string, offset bigint")


def _with_contents(records: DataFrame, folder: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = _Contents(folder)
        for batch in batches:
            texts = [contents.read(r["file"], r["offset"], r["size"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "content"])

    return records.mapInArrow(read, StructType([*records.schema.fields]).add("content", "binary"))


def deduplicate(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, keep_id, group_size, kept, text_sha256 (hex), row_id. ``digest_bytes`` cuts
    the state's key; contents decide what is equal at any length.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "content")
    records, landed = materialised(land(docs, folder), "landed")
    seen, used = keep_first(spark, landed, digest_bytes)
    seen, first_seen = materialised(seen, "kept")
    forget(spark, *used)
    digest = F.substring("sha256", 1, digest_bytes)
    joined = records.withColumn("digest", digest).join(seen, "digest")
    hits = (
        joined.where((F.col("file") != F.col("first.file")) | (F.col("offset") != F.col("first.offset")))
        .select("file", "offset", "size", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("file", "offset", "size")])
        .distinct()
        .repartition("file", "first_file")
        .sortWithinPartitions("first_file", "first_offset", "file", "offset")
    )
    bad, bad_path = materialised(differing(hits, folder), "differing")
    if bad.isEmpty():
        forget(spark, folder, bad_path)
        first, n = F.col("first"), F.col("n")
        rows = joined
    else:
        rows = _regrouped(joined, bad, folder)
        first, n = F.col("first"), F.col("n")
    return rows.select(
        "doc_id",
        first["doc_id"].alias("keep_id"),
        n.alias("group_size"),
        (F.col("row_id") == first["row_id"]).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
        "row_id",
    )


def _regrouped(joined: DataFrame, bad: DataFrame, folder: str) -> DataFrame:
    """Rows with their group when some digests cover different texts."""
    place = ["file", "offset"]
    first = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "row_id", "file", "offset", "size")
    apart = joined.join(bad, place, "left_semi")
    fewer = apart.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
    same = (
        joined.join(bad, place, "left_anti")
        .join(fewer, "digest", "left")
        .withColumn("n", F.col("n") - F.coalesce("less", F.lit(0)))
        .select("doc_id", "row_id", "sha256", "first", "n")
    )
    texts, _ = materialised(_with_contents(apart.select("doc_id", "row_id", "sha256", "digest", "file", "offset", "size"), folder), "apart")
    groups = texts.groupBy("digest", "content").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    other = texts.join(groups, ["digest", "content"]).select("doc_id", "row_id", "sha256", "first", "n")
    return same.unionByName(other)
