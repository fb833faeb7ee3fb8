"""Importance resampling of documents towards a target text, by hashed word n-grams.

Features are runs of one to three words. Their CRC-32 deals them to buckets; a bucket's gain is
the log ratio of its share in the target to its share in the corpus, a document's weight is the
sum of the gains of its features, and the documents with the greatest weight plus Gumbel noise
are drawn: that is sampling without replacement in proportion to the weights.

Features are interned per batch in an open-addressed table of NumPy arrays: the XXH64 of a
feature is its key and its first slot, a slot names the feature that took it, and whoever meets
a slot with its own key compares lengths and bytes before sharing it, else goes on to the next.
A slot holds a bucket, computed once per distinct feature, and a count. The first pass over the
corpus adds the counts up by bucket (a task returns one row per bucket), the second gathers the
gains by the slot ids of the occurrences. Both read whole texts; only the bucket counts, at most
10,000 of them, pass through the driver.

Null and empty texts have no features and weight 0. A null doc_id draws its noise from the seed
alone and comes after others of its score. Repeated rows are rows of their own. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from feedloom.llm.storage import materialised
from feedloom.operators.order import number_rows

#: Bytes of text whose features are interned together.
PORTION = 1 << 21
#: Longer features are hashed one by one.
VECTOR_BYTES = 64

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words, lower case: digits, letters and all beyond ASCII.
_IN_WORD = ((_LOWER >= 0x30) & (_LOWER <= 0x39)) | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_LOWER >= 0x80)

# Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    0x9E3779B185EBCA87,
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5,
)


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 register after each byte, and after each two bytes and 0, 2, 4 or 6 zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    step = lambda r: one[r & 0xFF] ^ (r >> 8)
    two = [step(step(np.arange(1 << 16, dtype=np.uint32)))]
    for _ in range(3):
        two.append(step(step(two[-1])))
    return one, np.stack(two)


_CRC_ONE, _CRC_TWO = _crc_tables()


def _times(x: np.ndarray, factor: int) -> np.ndarray:
    return x * np.uint64(factor)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class _Text:
    """Words of a portion, each followed by one space, and unaligned reads of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """``data``: the bytes of all texts; text k is offsets[k]..offsets[k + 1]."""
        small = _LOWER[data]
        inside = _IN_WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        starts = np.flatnonzero(begins)
        sizes = np.flatnonzero(ends) + 1 - starts
        #: First word of each text, and the number of all words.
        self.cuts = np.searchsorted(starts, offsets)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes
        spaced = np.full(int(np.sum(sizes + 1)) + 8, 0x20, np.uint8)
        letters = np.ones(len(spaced), bool)
        letters[self.ends] = letters[len(spaced) - 8 :] = False
        spaced[letters] = small[inside]
        self.raw = spaced.tobytes()
        n = len(spaced) - 7
        self.lanes = [np.ndarray((n,), kind, self.raw, strides=(1,)) for kind in ("<u8", "<u4", "u1")]

    def lane(self, at: np.ndarray, size: int) -> np.ndarray:
        """The 8, 4 or 1 bytes at each place, as 64-bit integers."""
        return self.lanes[(8, 4, 1).index(size)][at].astype(np.uint64, copy=False)

    def occurrences(self, longest: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, end and text of every run of 1 to ``longest`` words."""
        of = np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))
        a, b, texts = [], [], []
        for k in range(1, longest + 1):
            whole = np.flatnonzero(of[k - 1 :] == of[: len(of) - k + 1]) if len(of) >= k else np.empty(0, np.int64)
            a.append(self.starts[whole])
            b.append(self.ends[whole + k - 1])
            texts.append(of[whole])
        return np.concatenate(a), np.concatenate(b), np.concatenate(texts)


def xxh64(text: _Text, at: np.ndarray, size: int) -> np.ndarray:
    """XXH64, seed 0, of the ``size`` bytes at each place."""
    if size > VECTOR_BYTES:
        return np.fromiter((xxhash.xxh64_intdigest(text.raw[i : i + size]) for i in at.tolist()), np.uint64, len(at))

    def mixed(lane: np.ndarray) -> np.ndarray:
        return _times(_turn(_times(lane, _P2), 31), _P1)

    done = 0
    if size >= 32:
        rows = [np.full(len(at), x & (1 << 64) - 1, np.uint64) for x in (_P1 + _P2, _P2, 0, -_P1)]
        while done + 32 <= size:
            for k in range(4):
                rows[k] = _times(_turn(rows[k] + _times(text.lane(at + done + 8 * k, 8), _P2), 31), _P1)
            done += 32
        h = _turn(rows[0], 1) + _turn(rows[1], 7) + _turn(rows[2], 12) + _turn(rows[3], 18)
        for row in rows:
            h = _times(h ^ mixed(row), _P1) + np.uint64(_P4)
    else:
        h = np.full(len(at), _P5, np.uint64)
    h = h + np.uint64(size)
    while done + 8 <= size:
        h = _times(_turn(h ^ mixed(text.lane(at + done, 8)), 27), _P1) + np.uint64(_P4)
        done += 8
    if done + 4 <= size:
        h = _times(_turn(h ^ _times(text.lane(at + done, 4), _P1), 23), _P2) + np.uint64(_P3)
        done += 4
    while done < size:
        h = _times(_turn(h ^ _times(text.lane(at + done, 1), _P5), 11), _P1)
        done += 1
    h = _times(h ^ (h >> np.uint64(33)), _P2)
    h = _times(h ^ (h >> np.uint64(29)), _P3)
    return h ^ (h >> np.uint64(32))


def crc32(text: _Text, at: np.ndarray, size: int) -> np.ndarray:
    """CRC-32 of the ``size`` bytes at each place."""
    if size > VECTOR_BYTES:
        return np.fromiter((zlib.crc32(text.raw[i : i + size]) for i in at.tolist()), np.int64, len(at))
    r, done = np.full(len(at), 0xFFFFFFFF, np.uint64), 0
    for step in (8, 4):
        while done + step <= size:
            r ^= text.lane(at + done, step)
            pairs = [(r >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(step // 2)]
            looked = [_CRC_TWO[step // 2 - 1 - k][v.astype(np.int64)] for k, v in enumerate(pairs)]
            r = np.bitwise_xor.reduce(looked).astype(np.uint64)
            done += step
    while done < size:
        low = ((r ^ text.lane(at + done, 1)) & np.uint64(0xFF)).astype(np.int64)
        r, done = _CRC_ONE[low].astype(np.uint64) ^ (r >> np.uint64(8)), done + 1
    return (r ^ np.uint64(0xFFFFFFFF)).astype(np.int64)


class FeatureTable:
    """Distinct features of a portion of text, in open addressing.

    ``slots`` has the slot of every occurrence; ``bucket`` and ``count`` are by slot.
    """

    def __init__(self, text: _Text, starts: np.ndarray, ends: np.ndarray, buckets: int):
        n = len(starts)
        places = 1 << max(4, (2 * n - 1).bit_length() if n else 0)
        self.mask = np.int64(places - 1)
        self.text, self.starts, self.sizes = text, starts, ends - starts
        #: By slot: the occurrence that took it (none: -1), its key and its bucket.
        self.owner = np.full(places, -1, np.int32)
        self.key = np.zeros(places, np.uint64)
        self.bucket = np.zeros(places, np.int32)
        self.slots = np.empty(n, np.int32)
        # Features of one length are hashed and compared together.
        short = n and self.sizes.max() < 1 << 16
        order = np.argsort(self.sizes.astype(np.uint16) if short else self.sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(self.sizes[order], prepend=-1))
        for low, high in zip(cuts, np.r_[cuts[1:], n]):
            self._place(order[low:high], int(self.sizes[order[low]]), buckets)
        self.count = np.bincount(self.slots, minlength=places)

    def _place(self, which: np.ndarray, size: int, buckets: int) -> None:
        """Find or take a slot for each of the occurrences ``which``, all of ``size`` bytes."""
        keys = self._keys(which, size)
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(which):
            free = self.owner[at] < 0
            # Of several that take a slot at once, one stays; the others meet it below.
            self.owner[at[free]] = which[free]
            other = self.owner[at]
            won = np.flatnonzero(other == which)
            self.key[at[won]] = keys[won]
            self.bucket[at[won]] = crc32(self.text, self.starts[which[won]], size) % buckets
            same = self.key[at] == keys
            met = np.flatnonzero(same & (other != which))
            same[met] = self._equal(which[met], other[met], size)
            self.slots[which[same]] = at[same]
            which, keys, at = which[~same], keys[~same], (at[~same] + 1) & self.mask

    def _keys(self, which: np.ndarray, size: int) -> np.ndarray:
        return xxh64(self.text, self.starts[which], size)

    def _equal(self, which: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
        """Whether the bytes of occurrences are those of others of their size."""
        equal = self.sizes[other] == size
        alike = np.flatnonzero(equal)
        a, b = self.starts[which[alike]], self.starts[other[alike]]
        same, done = np.ones(len(alike), bool), 0
        if size > VECTOR_BYTES:
            raw = self.text.raw
            same = np.fromiter((raw[i : i + size] == raw[j : j + size] for i, j in zip(a.tolist(), b.tolist())), bool, len(a))
            done = size
        for step in (8, 4, 1):
            while done + step <= size:
                same &= self.text.lane(a + done, step) == self.text.lane(b + done, step)
                done += step
        equal[alike] = same
        return equal


def _portions(texts: pa.Array) -> Iterator[tuple[int, int, _Text]]:
    """(first row, end, words) of rows with about PORTION bytes, or one longer text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PORTION, "right")) - 1)
        yield start, end, _Text(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        start = end


def bucket_counts(texts: DataFrame, buckets: int) -> list[int]:
    """How many features of all ``texts`` (column text) each bucket has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, text in _portions(batch.column(0)):
                starts, ends, _ = text.occurrences()
                table = FeatureTable(text, starts, ends, buckets)
                held = np.flatnonzero(table.count)
                total += np.bincount(table.bucket[held], weights=table.count[held], minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n bigint")
    out = [0] * buckets
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of each bucket's share in the target to that in the source."""
    n, s, t = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source, target)]


def weights(docs: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, row (a number of its own), n_words, n_features and weight of every document."""
    by_bucket = np.array(gain, np.int64)
    schema = "doc_id bigint, row bigint, n_words bigint, n_features bigint, weight bigint"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], []]
            for start, end, text in _portions(batch.column(1)):
                starts, ends, of = text.occurrences()
                table = FeatureTable(text, starts, ends, len(by_bucket))
                gained = by_bucket[table.bucket][table.slots]
                columns[0].append(np.diff(text.cuts))
                columns[1].append(np.bincount(of, minlength=end - start))
                # Sums of integers, exact in doubles.
                columns[2].append(np.bincount(of, weights=gained, minlength=end - start).astype(np.int64))
            numbers = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in columns]
            rows = pa.array(np.arange(first, first + len(batch)))
            first += len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, *numbers], ["doc_id", "row", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(weigh, schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, drawn from a digest of the seed and the document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def _ranked(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with a rank for the first ``percent`` by score, ties to the smaller doc_id."""
    order = ["falling", "unnamed", "doc_id", "row"]
    sorted_rows = number_rows(rows.withColumn("falling", -F.col("score")).withColumn("unnamed", F.isnull("doc_id")), *order)
    # Numbers restart in every partition of the sort, of which there are few.
    part, within = F.shiftright("seq", 33), F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_rows.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["part"], before))
        before += r["count"]
    drawn = before * percent // 100
    placed = sorted_rows.withColumn("part", part).join(rows.sparkSession.createDataFrame(offsets, "part bigint, before bigint"), "part")
    rank = F.col("before") + within + 1
    return placed.withColumn("rank", F.when(rank <= drawn, rank)).select(*rows.columns, "rank")


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_features, weight, score and, if drawn, rank.

    ``target`` has a column text. Of the documents with ``least_words`` words or more, the
    ``percent`` with the greatest scores are drawn; the others have a null rank.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows, _ = materialised(scored, "weights")
    enough = F.col("n_words") >= least_words
    ranked = _ranked(rows.where(enough), percent)
    return ranked.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("bigint")))
