"""Periodic runs of words, by catching squares online over dyadic blocks.

Words are appended to a stream. As soon as 2^k words that begin at a multiple of 2^k are there,
that block has a catcher. Every appended word ends one suffix of 2^k words for each k, and the
suffix is compared with the two catchers that lie two to four blocks back: if it equals the block
that began q words earlier, a stretch of words equals the stretch q words before. Matches of
neighbouring blocks at one distance q join, and once the stretch has q words it is a square; the
stretch with the q words before it is all that keeps period q, that is, a run. Comparing costs
two look-ups a word and level, by prefix hashes; the words themselves decide the ends of every
run and check its inside, so a collision costs time and nothing else.

A batch of documents is one stream with a word of its own after every document, which no run can
cross. Work is narrow: nothing is shuffled and a document is never cut, so its runs are whole.

Null and empty texts have no words, no runs, and the digests of the empty string. A null doc_id
leaves its words as they are. Repeated rows are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of one stream (or one longer document), and words appended to it at a time.
STREAM_WORDS, APPENDED_WORDS = 1 << 20, 1 << 18
#: Odd multiplier of the prefix hashes.
MULTIPLIER = 0x9E3779B97F4A7C15

SCHEMA = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)
_ROW = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256")]
)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class SquareCatchers:
    """Runs of a stream of at most ``capacity`` words, given as integers.

    A run has smallest period q, at least ``exponent`` (2 or more) times q words and at least
    ``least`` words. ``longest`` bounds the words of a run, and with it the levels of catchers.
    The runs do not depend on how the stream is cut into appended pieces.
    """

    def __init__(self, capacity: int, longest: int | None = None, exponent: int = 4, least: int = 6):
        self.exponent, self.least = exponent, least
        longest = capacity if longest is None else min(longest, capacity)
        #: A run of period q is caught at the level whose blocks are half to a quarter of q.
        self.levels = [1 << k for k in range(max(1, longest.bit_length())) if k == 0 or 2 * exponent << k <= longest]
        self.words = np.zeros(capacity, np.int64)
        self.n = 0
        self.power, self.inverse = _powers(MULTIPLIER, capacity + 1), _powers(pow(MULTIPLIER, -1, 1 << 64), capacity + 1)
        self.prefix = np.zeros(capacity + 1, np.uint64)
        #: By level, matched stretches that may still grow: distance, first block, last block.
        self.open = {h: np.empty((0, 3), np.int64) for h in self.levels}
        self.stretches: list[np.ndarray] = []

    def append(self, words: np.ndarray) -> None:
        """Append words: each ends suffixes that are compared with the catchers behind it."""
        before, self.n = self.n, self.n + len(words)
        self.words[before : self.n] = words
        mixed = words.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        sums = np.cumsum(mixed * self.power[before : self.n], dtype=np.uint64)
        self.prefix[before + 1 : self.n + 1] = self.prefix[before] + sums
        for h in self.levels:
            caught = self._caught(h, max(0, before - h + 1), self.n - h + 1)
            self._join(h, caught)

    def _names(self, at: np.ndarray | slice, h: int) -> np.ndarray:
        """Hashes of the ``h`` words that begin at each place."""
        if isinstance(at, slice):
            return (self.prefix[at.start + h : at.stop + h] - self.prefix[at]) * self.inverse[at]
        return (self.prefix[at + h] - self.prefix[at]) * self.inverse[at]

    def _caught(self, h: int, low: int, high: int) -> np.ndarray:
        """(distance, block) of the catchers that suffixes beginning in low..high-1 equal."""
        if high <= low:
            return np.empty((0, 2), np.int64)
        names = self._names(slice(low, high), h)
        first = low // h
        blocks = self._names(np.arange(max(0, first - 3), (high - 1) // h) * h, h)
        found = []
        for back in (1, 2, 3) if h == 1 else (2, 3):
            # The suffix that begins at i meets block i // h - back.
            start = max(low, back * h)
            if start >= high:
                continue
            skip = max(0, first - 3)
            met = np.repeat(blocks[start // h - back - skip : (high - 1) // h - back - skip + 1], h)
            met = met[start % h : start % h + high - start]
            i = np.flatnonzero(names[start - low :] == met) + start
            block = (i // h - back) * h
            found.append(np.stack([i - block, block], 1))
        return np.concatenate(found) if found else np.empty((0, 2), np.int64)

    def _join(self, h: int, caught: np.ndarray) -> None:
        """Join matches of neighbouring blocks at one distance; close those that cannot grow."""
        if not len(caught) and not len(self.open[h]):
            return
        rows = np.concatenate([self.open[h], caught[:, [0, 1, 1]]])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        q, first, last = rows.T
        lead = np.r_[True, (q[1:] != q[:-1]) | (first[1:] != last[:-1] + h)]
        ends = np.r_[np.flatnonzero(lead)[1:], len(rows)] - 1
        rows = np.stack([q[lead], first[lead], last[ends]], 1)
        grows = rows[:, 2] + h + rows[:, 0] > self.n - h
        self.open[h] = rows[grows]
        self._close(h, rows[~grows])

    def _close(self, h: int, rows: np.ndarray) -> None:
        """Keep the matched stretches that have enough whole blocks for a run."""
        needed = np.maximum(1, ((self.exponent - 1) * rows[:, 0] - h + 1) // h)
        rows = rows[(rows[:, 2] - rows[:, 1]) // h + 1 >= needed]
        if len(rows):
            self.stretches.append(np.stack([rows[:, 0], rows[:, 1], rows[:, 2] + h, np.full(len(rows), h)], 1))

    def _widened(self, q: int, low: int, high: int, h: int) -> tuple[int, int]:
        """The stretch low..high-1 that equals the one q later, with what else does at its ends."""
        w, n = self.words, self.n
        while low > 0:
            step = min(h, low)
            apart = np.flatnonzero(w[low - step : low] != w[low - step + q : low + q])
            if len(apart):
                low -= step - 1 - int(apart[-1])
                break
            low -= step
        while high + q < n:
            step = min(h, n - q - high)
            apart = np.flatnonzero(w[high : high + step] != w[high + q : high + q + step])
            if len(apart):
                high += int(apart[0])
                break
            high += step
        return low, high

    def runs(self) -> np.ndarray:
        """(start, length, period) of every run of the words appended, by start, then period."""
        for h in self.levels:
            rows, self.open[h] = self.open[h], self.open[h][:0]
            self._close(h, rows)
        # A stretch that several periods keep is named by the smallest: the others are its multiples.
        wide: dict[tuple[int, int], list[int]] = {}
        for q, low, high, h in np.concatenate(self.stretches).tolist() if self.stretches else []:
            low, high = self._widened(q, low, high, h)
            wide.setdefault((low, high + q), []).append(q)
        found = {}
        for (start, end), periods in wide.items():
            for q in sorted(periods):
                parts = self._checked(start, end, q)
                for part in parts:
                    if found.get(part, q) >= q:
                        found[part] = q
                if (start, end) in parts:
                    break
        rows = [(x, y - x, q) for (x, y), q in found.items() if y - x >= max(self.least, self.exponent * q)]
        return np.array(sorted(rows, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)

    def _checked(self, start: int, end: int, q: int) -> list[tuple[int, int]]:
        """The whole stretch if it does keep period q, else the parts of it that do."""
        same = self.words[start : end - q] == self.words[start + q : end]
        if same.all():
            return [(start, end)]
        edges = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8))).reshape(-1, 2)
        return [(start + a, start + b + q) for a, b in edges.tolist()]


def planted_order(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which of a document's ``n`` words stands at each place, for the tenth of all documents,
    chosen by their id, whose end is made periodic; None for the others."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.r_[0:a, a + np.arange(n - a) % p]


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _row(doc_id: int | None, spelled: list[bytes], runs: np.ndarray) -> tuple:
    """A document's row: its runs, the strongest of them, and what is left of its words."""
    if not len(runs):
        return (doc_id, 0, None, None, None, None, _digest(b""), _digest(b" ".join(spelled)))
    rows = runs.tolist()
    best = rows[0]
    for r in rows[1:]:
        # Rows come by start, then period: only a greater length / period takes the place.
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    listed = "".join([f"{a},{b},{c}\n" for a, b, c in rows]).encode()
    cover = np.zeros(len(spelled) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    left = np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()
    collapsed = b" ".join([spelled[i] for i in left])
    return (doc_id, len(rows), *best, 1000 * best[1] // best[2], _digest(listed), _digest(collapsed))


def _stream_rows(ids: list, texts: list, exponent: int, least: int, planted: bool) -> Iterator[tuple]:
    """Rows of the documents of one stream."""
    number: dict[bytes, int] = {}
    pieces, spelled = [], []
    for k, (doc_id, text) in enumerate(zip(ids, texts)):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if planted and (order := planted_order(len(words), doc_id)) is not None:
            words = [words[i] for i in order.tolist()]
        pieces += [np.array([number.setdefault(w, len(number)) for w in words], np.int64), np.array([-1 - k])]
        spelled.append(words)
    stream = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
    catchers = SquareCatchers(len(stream), max(map(len, spelled), default=0), exponent, least)
    for i in range(0, len(stream), APPENDED_WORDS):
        catchers.append(stream[i : i + APPENDED_WORDS])
    runs = catchers.runs()
    starts = np.cumsum([0] + [len(w) + 1 for w in spelled])
    cuts = np.searchsorted(runs[:, 0], starts)
    for k, (doc_id, words) in enumerate(zip(ids, spelled)):
        own = runs[cuts[k] : cuts[k + 1]] - [starts[k], 0, 0]
        yield _row(doc_id, words, own)


def collapse_runs(docs: DataFrame, exponent: int = 4, least: int = 6, planted: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its runs and its words without their repeats.

    n_runs; start, length, period and exponent_milli of the run with the greatest length / period
    (ties: smallest start, then period; nulls without a run); runs_sha256 of all runs and
    collapsed_sha256 of the words that follow no run's first period inside it. ``planted`` first
    makes the end of a tenth of the documents periodic (``planted_order``).
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A text has at most one word in two bytes, and usually one in six.
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(batch):
                before = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, before + 4 * STREAM_WORDS, "right")))
                ids, texts = (batch.column(c)[start:end].to_pylist() for c in (0, 1))
                rows = list(_stream_rows(ids, texts, exponent, least, planted))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)
                start = end

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(find, SCHEMA)
