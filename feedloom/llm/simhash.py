"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most three bits exactly if some value lies within one bit of the
first and two bits of the second. Every distinct fingerprint therefore spans the ball of radius
one and the ball of radius two, and fingerprints meet where the balls do. The variants are
dealt by their leading bits: a fingerprint travels once to each prefix its variants can have,
with the bits already flipped, and the variants of the other bits are spelled out where it
arrives. Prefixes that many fingerprints share, or that many reach with bits flipped, are dealt
again by more bits, so that no task's share grows with a group of near copies. At every variant
the fingerprints are linked to one centre (not pairwise), the distance is verified, and each
prefix returns a spanning forest of its links, which connected components join.

Null and empty texts have fingerprint zero. Repeated rows are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.components import connected_components
from feedloom.llm.storage import materialised

#: Fingerprints that should share a prefix, and the most before it is dealt again. Flipped ones may
#: be as many times more as there are ways to flip the prefix.
OWN, MOST_OWN = 1024, 8192
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str | None, length: int = 3, seed: int = 42) -> int:
    """Majority of each bit over the XXH64 of all shingles of ``length`` words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - length + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(length, len(words)) - 1 :]
    slices = map(joined.__getitem__, map(slice, starts[:n].tolist(), last.tolist()))
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), slices), np.uint64, n)
    counts = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, length: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_hash and the fingerprint as a signed 64-bit integer, one row per document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_signed(fingerprint(t, length, seed)) for t in batch.column(2).to_pylist()]
            columns = [*batch.columns[:2], pa.array(values, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "bits"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(read, "doc_id bigint, text_hash bigint, bits bigint")


def _flips(low: int, high: int, most: int) -> list[tuple[int, int]]:
    """Masks of up to ``most`` of the bits low..high-1, and how many bits each has."""
    return [(_signed(sum(1 << b for b in c)), k) for k in range(most + 1) for c in combinations(range(low, high), k)]


def _dealt(rows: DataFrame, bits: int, more: int, radius: int) -> DataFrame:
    """Rows dealt by ``more`` bits beyond the leading ``bits``: one for each way to flip those."""
    masks = _flips(64 - bits - more, 64 - bits, radius)
    ways = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(k).alias("k")) for m, k in masks])
    out = rows.withColumn("way", F.explode(ways)).withColumn("flipped", F.col("flipped") + F.col("way.k"))
    return out.where(F.col("flipped") <= radius).select(
        "bits",
        F.col("moved").bitwiseXOR(F.col("way.mask")).alias("moved"),
        "flipped",
        F.lit(bits + more).alias("depth"),
    )


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Forest edges (src, dst) that connect distinct fingerprints (``bits``) within ``radius``."""
    inner, outer = radius // 2, radius - radius // 2
    n = distinct.count()
    depth = min(20, max(4, math.ceil(math.log2(max(1, n) / OWN))))
    rows = distinct.select("bits", F.col("bits").alias("moved"), F.lit(0).alias("flipped"), F.lit(0).alias("depth"))
    rows = _dealt(rows, 0, depth, outer)
    prefix = F.shiftrightunsigned("moved", 64 - depth)
    settled = None
    while True:
        rows = rows.withColumn("part", prefix)
        if depth > 56:  # 2^(64 - depth) tails with up to ``outer`` flips: bounded
            break
        # A cold prefix beside a hot one receives the hot one's fingerprints with bits flipped.
        ways = sum(math.comb(depth, k) for k in range(outer + 1))
        shares = rows.groupBy("part").agg(F.count_if(F.col("flipped") == 0).alias("own"), F.count(F.lit(1)).alias("every"))
        hot = shares.where((F.col("own") > MOST_OWN) | (F.col("every") > MOST_OWN * ways))
        hot, _ = materialised(hot.select("part"), "hot-prefixes")
        if hot.isEmpty():
            break
        cold = rows.join(hot, "part", "left_anti")
        settled = cold if settled is None else settled.unionByName(cold)
        rows = _dealt(rows.join(hot, "part", "left_semi").drop("part"), depth, 4, outer)
        depth += 4
        prefix = F.shiftrightunsigned("moved", 64 - depth)
    rows = rows if settled is None else settled.unionByName(rows)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        return _meet(group, inner, outer, radius)

    return rows.groupBy("depth", "part").applyInPandas(meet, "src bigint, dst bigint")


def _meet(group: pd.DataFrame, inner: int, outer: int, radius: int) -> pd.DataFrame:
    """Links of the fingerprints of one prefix, as a spanning forest."""
    free = 64 - int(group["depth"].iloc[0])
    own = group["bits"].to_numpy().view(np.uint64)
    tail = group["moved"].to_numpy().view(np.uint64) & np.uint64((1 << free) - 1)
    flipped = group["flipped"].to_numpy()
    masks = [np.array([m & (1 << 64) - 1 for m, k in _flips(0, free, outer) if k == size], np.uint64) for size in range(outer + 1)]

    def ball(reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(variants, rows) within ``reach`` bits, in pieces of bounded size."""
        for row in range(0, reach + 1):
            rows = np.flatnonzero(flipped == row)
            every = np.concatenate(masks[: reach - row + 1])
            step = max(1, (1 << 22) // len(every))
            for i in range(0, len(rows), step):
                at = rows[i : i + step]
                yield (tail[at][:, None] ^ every).ravel(), np.repeat(at, len(every))

    inside = list(ball(inner))
    variants, rows = (np.concatenate(x) for x in zip(*inside)) if inside else (np.empty(0, np.uint64), np.empty(0, np.int64))
    order = np.lexsort((own[rows], variants))
    variants, rows = variants[order], rows[order]
    lead = np.concatenate([[True], variants[1:] != variants[:-1]]) if len(variants) else np.empty(0, bool)
    variants, centre = variants[lead], rows[lead]
    mask = np.uint64((1 << 20) - 1)
    mix = lambda v: ((v ^ (v >> np.uint64(23)) ^ (v >> np.uint64(41))) & mask).astype(np.int64)
    table = np.zeros(1 << 20, bool)
    table[mix(variants)] = True
    pairs = []
    for other, at in ball(outer):
        maybe = table[mix(other)]
        other, at = other[maybe], at[maybe]
        place = np.searchsorted(variants, other)
        place[place == len(variants)] = 0
        met = variants[place] == other if len(variants) else np.zeros(len(other), bool)
        a, b = centre[place[met]], at[met]
        a, b = a[own[a] != own[b]], b[own[a] != own[b]]
        pairs.append(np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64))
    pair = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
    values, number = np.unique(own, return_inverse=True)
    near = np.bitwise_count(own[pair[:, 0]] ^ own[pair[:, 1]]) <= radius
    edge = number[pair[near]].reshape(-1, 2)
    label = np.arange(len(values))
    while len(edge):
        low = np.minimum(label[edge[:, 0]], label[edge[:, 1]])
        after = label.copy()
        np.minimum.at(after, edge[:, 0], low)
        np.minimum.at(after, edge[:, 1], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    tied = np.flatnonzero(label != np.arange(len(values)))
    return pd.DataFrame({"src": values[tied].view(np.int64), "dst": values[label[tied]].view(np.int64)})


def near_duplicates(docs: DataFrame, length: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (hex), component_id,
    text_hash (XXH64 of the text) and component (a fingerprint that names the group).

    component_id is the smallest doc_id that links reach (null where none has an id).
    """
    rows, _ = materialised(fingerprints(docs, length, seed), "fingerprints")
    distinct, _ = materialised(rows.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    edges, _ = materialised(links(distinct, radius), "fingerprint-links")
    roots = connected_components(edges)
    of = distinct.join(roots, distinct["bits"] == roots["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    lowest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(lowest, "root").select("bits", "component_id", F.col("root").alias("component"))
    shown = F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint")
    return rows.join(named, "bits").select("doc_id", shown, "component_id", "text_hash", "component")
