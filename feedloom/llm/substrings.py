"""Repeated passages removed across documents, by super-k-mer partitioning.

A window is ``length`` consecutive words; its minimiser is the least hash among its runs of
MINIMISER words. Consecutive windows that share a minimiser travel as one packed string to the
minimiser's bucket, where the windows are sorted and each gets the smallest doc_id it starts
in. A first pass finds the minimisers that several documents share, and a bit filter of bounded
size keeps other strings at home (its false hits only travel in vain). Equal strings are
combined before they travel, by a 128-bit digest. Buckets that still hold very many strings are
split: their windows are counted by 128-bit digests instead, combined before the shuffle.

Windows are judged on the input, so what is removed from one document does not protect another.
A null text has no words. A null doc_id counts as larger than all others. Rows that repeat a
doc_id never remove from each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from feedloom.llm.storage import forget, materialised

LENGTH, MINIMISER = 50, 10
#: Windows of one packed string, strings of a bucket that is not split, bits of the filter.
MOST_WINDOWS, MOST_STRINGS, MOST_BITS = 512, 4096, 1 << 27
_LAST = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

PARTS = (
    "row bigint, rank bigint, doc_id bigint, n_words bigint, kept_sha256 string, words binary, "
    "bucket bigint, sid binary, packed binary, start int, windows int"
)
_PARTS = pa.schema(
    [
        ("row", pa.int64()),
        ("rank", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("kept_sha256", pa.string()),
        ("words", pa.binary()),
        ("bucket", pa.int64()),
        ("sid", pa.binary()),
        ("packed", pa.binary()),
        ("start", pa.int32()),
        ("windows", pa.int32()),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def super_windows(words: list[bytes], length: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one minimiser: bucket, first window, number of windows."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = _mixed(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))
    runs = np.zeros(len(words) - minimiser + 1, np.uint64)
    for i in range(minimiser):
        runs = runs * _ODD + h[i : i + len(runs)]
    least, span, wide = _mixed(runs), 1, length - minimiser + 1
    while span * 2 <= wide:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.append(starts, n))
    if sizes.max() > MOST_WINDOWS:
        pieces = [np.arange(s, s + k, MOST_WINDOWS) for s, k in zip(starts, sizes)]
        starts = np.concatenate(pieces)
        sizes = np.diff(np.append(starts, n))
    return least[starts].view(np.int64), starts, sizes


def shared_minimisers(docs: DataFrame, length: int, minimiser: int) -> DataFrame:
    """Buckets that documents of different rank meet in."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, ranks = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for rank, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.unique(super_windows(words_of(text), length, minimiser)[0])
                buckets.append(own)
                ranks.append(np.full(len(own), rank, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(ranks))], ["bucket", "rank"])

    met = docs.select("rank", "text").mapInArrow(read, "bucket bigint, rank bigint")
    return met.groupBy("bucket").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("lo < hi").select("bucket")


def bit_filter(buckets: DataFrame) -> np.ndarray:
    """A Bloom filter of the buckets with two bits each, at most MOST_BITS wide."""
    n = buckets.count()
    bits = min(MOST_BITS, 1 << max(10, (16 * n).bit_length()))
    place = F.explode(F.array(F.col("bucket"), F.shiftrightunsigned("bucket", 32))).alias("at")
    rows = (
        buckets.select(place)
        .select(F.col("at").bitwiseAND(bits - 1).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    )
    table = rows.toArrow()
    cells = np.zeros(bits // 64, np.int64)
    cells[table.column("cell").to_numpy()] = table.column("bits").to_numpy()
    return cells.view(np.uint64)


def _passes(cells: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    mask, found = np.uint64(len(cells) * 64 - 1), None
    for h in (buckets.view(np.uint64), buckets.view(np.uint64) >> np.uint64(32)):
        at = h & mask
        hit = (cells[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        found = hit if found is None else found & hit
    return found.astype(bool)


def strings_of(docs: DataFrame, cells: np.ndarray, length: int, minimiser: int) -> DataFrame:
    """A row per document, and a row per super-k-mer whose bucket passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(cells)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, held = [], 0
            for doc_id, rank, text in zip(*[c.to_pylist() for c in batch.columns]):
                words, row = words_of(text), (part << 36) | number
                number += 1
                joined = b" ".join(words)
                buckets, starts, sizes = super_windows(words, length, minimiser)
                met = np.flatnonzero(_passes(shared.value, buckets)) if len(buckets) else ()
                sha = hashlib.sha256(joined).hexdigest()
                rows.append((row, rank, doc_id, len(words), sha, joined if len(met) else None, None, None, None, None, None))
                held += len(joined)
                if len(met):
                    at = np.cumsum([0, *[len(w) + 1 for w in words]])
                    for bucket, s, k in zip(buckets[met].tolist(), starts[met].tolist(), sizes[met].tolist()):
                        packed = joined[at[s] : at[s + k + length - 1] - 1]
                        rows.append((row, rank, None, None, None, None, bucket, xxhash.xxh3_128_digest(packed), packed, s, k))
                        held += len(packed)
                if held > 1 << 24:
                    yield _parts(rows)
                    rows, held = [], 0
            yield _parts(rows)

    return docs.select("doc_id", "rank", "text").mapInArrow(read, PARTS)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_PARTS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PARTS)], schema=_PARTS)


def windows_in(packed: bytes, length: int) -> list[bytes]:
    """The windows of a packed string, in order."""
    words = packed.split(b" ")
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    return [packed[at[i] : at[i + length] - 1] for i in range(len(words) - length + 1)]


def _counted(strings: DataFrame, length: int) -> DataFrame:
    """Of strings together by bucket: windows that start in a document before the last to hold
    the string, with the first such document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        out: list[tuple] = []
        for _, group in groupby(rows, lambda r: r["bucket"]):
            group = list(group)
            split = [(r, windows_in(r["packed"], length)) for r in group]
            ordered = sorted((w, r["lo"]) for r, windows in split for w in windows)
            first: dict[bytes, int] = {}
            for w, lo in ordered:
                first.setdefault(w, lo)
            for r, windows in split:
                found = [(i, first[w]) for i, w in enumerate(windows) if first[w] < r["hi"]]
                if found:
                    out.append((r["sid"], *map(list, zip(*found))))
            if len(out) >= 2048:
                yield _cuts(out)
                out = []
        yield _cuts(out)

    return strings.select("bucket", "sid", "packed", "lo", "hi").mapInArrow(count, "sid binary, at array<int>, first array<bigint>")


def _cuts(rows: list[tuple]) -> pa.RecordBatch:
    sids, at, first = zip(*rows) if rows else ((), (), ())
    kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip((sids, at, first), kinds)], ["sid", "at", "first"])


def _counted_apart(strings: DataFrame, length: int) -> DataFrame:
    """The same for strings of split buckets, whose windows meet by digest."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows += [(r["sid"], i, xxhash.xxh3_128_digest(w), r["lo"], r["hi"]) for i, w in enumerate(windows_in(r["packed"], length))]
            columns = zip(*rows) if rows else [[]] * 5
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            names = ["sid", "i", "window", "lo", "hi"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    windows, _ = materialised(
        strings.select("sid", "packed", "lo", "hi").mapInArrow(spread, "sid binary, i int, window binary, lo bigint, hi bigint"),
        "split-windows",
    )
    first = windows.groupBy("window").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first < last")
    met = windows.join(first, "window").where("first < hi")
    listed = met.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("i", "first"))).alias("w"))
    return listed.select("sid", F.col("w.i").alias("at"), F.col("w.first").alias("first"))


def _intervals(met: DataFrame, length: int) -> DataFrame:
    """Word intervals to remove, from occurrences (row, rank, start) and their strings' windows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, rank, start, at, first in zip(*[c.to_pylist() for c in batch.columns]):
                end = None
                for i, f in zip(at, first):
                    if f < rank:
                        if end is not None and start + i <= end:
                            out[-1] = (row, out[-1][1], start + i + length)
                        else:
                            out.append((row, start + i, start + i + length))
                        end = start + i + length
            columns = zip(*out) if out else [[]] * 3
            kinds = [pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["row", "a", "b"])

    return met.select("row", "rank", "start", "at", "first").mapInArrow(read, "row bigint, a int, b int")


def _without(rows: DataFrame) -> DataFrame:
    """Documents (with words and intervals) after removal."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n_words, joined, spans in zip(*[c.to_pylist() for c in batch.columns]):
                gone = np.zeros(n_words + 1, np.int32)
                for s in spans:
                    gone[s["a"]] += 1
                    gone[s["b"]] -= 1
                gone = np.cumsum(gone)[:n_words] > 0
                kept = b" ".join([w for w, g in zip(joined.split(b" "), gone.tolist()) if not g])
                out.append((doc_id, n_words, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
            columns = zip(*out) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary"
    return rows.select("doc_id", "n_words", "words", "spans").mapInArrow(read, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, minimiser: int = MINIMISER) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, kept_sha256 and, for documents
    that lost words, the kept words joined by spaces (null: all words stay)."""
    spark = docs.sparkSession
    named = F.col("doc_id").cast("bigint")
    docs = docs.select(named.alias("doc_id"), F.coalesce(named, F.lit(_LAST)).alias("rank"), F.col("text").cast("string").alias("text"))
    buckets, buckets_path = materialised(shared_minimisers(docs, length, minimiser), "shared-minimisers")
    parts, _ = materialised(strings_of(docs, bit_filter(buckets), length, minimiser), "super-k-mers")
    forget(spark, buckets_path)
    found = parts.where("bucket is not null")
    strings, strings_path = materialised(
        found.groupBy("sid").agg(
            F.first("bucket").alias("bucket"), F.first("packed").alias("packed"), F.min("rank").alias("lo"), F.max("rank").alias("hi")
        ),
        "strings",
    )
    hot, _ = materialised(strings.groupBy("bucket").count().where(F.col("count") > MOST_STRINGS).select("bucket"), "hot-buckets")
    cool = strings.join(hot, "bucket", "left_anti")
    by_bucket = cool.repartition("bucket").sortWithinPartitions("bucket")
    cuts = _counted(by_bucket, length)
    if not hot.isEmpty():
        cuts = cuts.unionByName(_counted_apart(strings.join(hot, "bucket", "left_semi"), length))
    cuts, _ = materialised(cuts, "cuts")
    forget(spark, strings_path)
    spans = (
        _intervals(found.select("sid", "row", "rank", "start").join(cuts, "sid"), length)
        .groupBy("row")
        .agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    )
    whole = parts.where("bucket is null").join(spans, "row", "left")
    untouched = whole.where("spans is null").select(
        "doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256", F.lit(None).cast("binary").alias("kept")
    )
    return untouched.unionByName(_without(whole.where("spans is not null")))
