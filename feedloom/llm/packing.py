"""Packing token pieces into sequences by vector best-fit.

A piece is a vector of tokens, documents (one) and attention cost (its length squared); a
sequence has a capacity for each. Pieces are dealt at random to groups of bounded size and each
group is packed on its own, longest piece first, into the sequence that is best by a weighted
residual norm or dot-product among those in which every capacity holds. Groups of thousands of
pieces lose about one sequence each against packing all at once, and no task grows with the
data. Only documents over the token capacity are cut: pieces at capacity, the rest in front.

A null text is empty and is the end id alone. Rows with null or repeated ids are documents of
their own; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from feedloom.llm.tokens import encoder

#: Documents of a group; each has at most one piece below capacity.
GROUP = 8192


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. ``cost`` bounds the sum of squared piece lengths."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.cost], np.float64)


PIECES = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("row", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def pieces(docs: DataFrame, path: str, end_id: int = 2, tokens: int = 1024, keep_ids: bool = False) -> DataFrame:
    """The token pieces of ``docs`` (doc_id, text); ids (little-endian, 32 bits) if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, number = encoder(path).encode_many, int(end_id).to_bytes(4, "little"), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids += end
                n = len(ids) // 4
                first = n % tokens if n > tokens and n % tokens else min(n, tokens)
                for k, start in enumerate([0, *range(first, n, tokens)]):
                    own = ids[4 * start : 4 * (start + tokens if k else first)]
                    rows.append((doc_id, (part << 36) | number, k, start, len(own) // 4, zlib.crc32(own), own if keep_ids else None))
                number += 1
            columns = zip(*rows) if rows else [[]] * len(_PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: Capacity, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its bin and its offset there."""
    limit, weight = capacity.vector(), np.array(weights)
    lengths = np.asarray(lengths, np.int64)
    chosen, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = lengths >= capacity.tokens
    chosen[full] = np.arange(full.sum())
    bins = int(full.sum())
    order = np.flatnonzero(~full)
    order = order[np.argsort(-lengths[order], kind="stable")]
    room = np.empty((len(order), 3))
    names = np.empty(len(order), np.int64)
    used = 0
    smallest = lengths[order[-1]] if len(order) else 0
    for i in order:
        size = float(lengths[i])
        item = np.array([size, 1.0, size * size])
        left = room[:used] - item
        fits = np.flatnonzero((left >= 0).all(1))
        if len(fits):
            if rule == "norm":
                score = ((left[fits] / limit) ** 2) @ weight
            else:
                score = -(room[fits] / limit) @ (weight * item / limit)
            at = fits[np.argmin(score)]
        else:
            at, used = used, used + 1
            room[at], names[at] = limit, bins
            bins += 1
        chosen[i], offset[i] = names[at], capacity.tokens - room[at, 0]
        room[at] -= item
        if room[at, 0] < smallest or room[at, 1] < 1:
            used -= 1
            room[at], names[at] = room[used], names[used]
    return chosen, offset


def pack(
    pieces: DataFrame,
    groups: int,
    capacity: Capacity = Capacity(),
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6),
    rule: str = "norm",
) -> DataFrame:
    """Pieces with sequence_id and offset."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    if capacity.documents < 1 or capacity.cost < capacity.tokens**2:
        raise ValueError("a full piece must fit an empty sequence")

    def place(key: tuple, table: pa.Table) -> pa.Table:
        bins, offsets = best_fit(table.column("length").to_numpy(), capacity, weights, rule)
        table = table.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins, pa.int64()))
        return table.append_column("offset", pa.array(offsets, pa.int64())).drop_columns(["lot"])

    dealt = pieces.withColumn("lot", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    return dealt.groupBy("lot").applyInArrow(place, PIECES + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: Capacity = Capacity(), keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs`` with the vocabulary file at ``path``."""
    groups = max(1, -(-docs.count() // GROUP))
    return pack(pieces(docs, path, end_id, capacity.tokens, keep_ids), groups, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (little-endian, 32 bits), for pieces that kept theirs."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts["ids"], F.lit(b""), lambda acc, x: F.concat(acc, x))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
