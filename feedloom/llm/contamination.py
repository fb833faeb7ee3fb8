"""Benchmark decontamination on a positional inverted index of the training documents.

The index has one row per segment (up to 2^20 words of whole documents): the segment's terms,
how many documents hold each, and each term's ascending positions. Documents are laid on one
axis with gaps between them, so a phrase cannot match across two. A search takes the test
phrases in blocks of bounded size; in every segment it starts from the position list of a
phrase's rarest term over the whole corpus and intersects it with the offset-adjusted lists of
the others, rarer ones first. Nothing is shuffled but document frequencies.

Null and empty texts have no words. A document or item is one row: repeated rows are reported
each, rows with a null document id too. Items with a null id mark words as hit but are not
listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from feedloom.llm.storage import materialised

#: Words of a segment, and words left free between two documents on its axis.
SEGMENT_WORDS = 1 << 20
GAP = 64
#: Test vocabulary up to which the index is limited to it; beyond, all terms are stored.
MOST_TERMS = 1 << 20
#: Characters of test text matched at a time.
BLOCK_CHARS = 1 << 23

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20
    for b in range(256)
)

INDEX = (
    "segment string, terms array<binary>, n_docs array<int>, positions array<binary>, "
    "doc_ids array<bigint>, n_words array<int>"
)
FOUND = (
    "segment string, ordinal int, doc_id bigint, n_words bigint, "
    "spans array<struct<start:int,end:int>>, items array<string>, near_items array<string>"
)
_INDEX = pa.schema(
    [
        ("segment", pa.string()),
        ("terms", pa.list_(pa.binary())),
        ("n_docs", pa.list_(pa.int32())),
        ("positions", pa.list_(pa.binary())),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int32())),
    ]
)
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_FOUND = pa.schema(
    [
        ("segment", pa.string()),
        ("ordinal", pa.int32()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(_SPAN)),
        ("items", pa.list_(pa.string())),
        ("near_items", pa.list_(pa.string())),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lowered: runs of digits, a-z and everything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None) -> DataFrame:
    """Segments of the positional index of ``docs`` (doc_id, text).

    With a vocabulary (of checked size) only its terms get lists.
    """
    spark = docs.sparkSession
    shared = None if vocabulary is None else spark.sparkContext.broadcast(frozenset(vocabulary))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else {t: i for i, t in enumerate(sorted(shared.value))}
        terms = None if known is None else sorted(known)
        number = {} if known is None else known
        part, n = TaskContext.get().partitionId(), 0
        ids, counts, seen, at, where = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, counts, seen, at, where, number, n
            names = terms if known is not None else list(number)
            term = np.concatenate(seen) if seen else np.empty(0, np.int32)
            place = np.concatenate(at) if at else np.empty(0, np.int32)
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            cuts = np.flatnonzero(np.diff(term)) + 1
            first = term[np.concatenate([[0], cuts])] if len(term) else term
            sizes = np.array(counts, np.int64) + GAP
            bases = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
            lists, n_docs = [], []
            for own in np.split(place, cuts) if len(term) else []:
                owner = np.searchsorted(bases, own, "right")
                n_docs.append(int(1 + np.count_nonzero(np.diff(owner))))
                lists.append(pack(own))
            row = [[f"{part}-{n}"], [[names[i] for i in first]], [n_docs], [lists], [ids], [counts]]
            ids, counts, seen, at, where, n = [], [], [], [], 0, n + 1
            if known is None:
                number = {}
            return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(row, _INDEX)], schema=_INDEX)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if known is None:
                    own = np.array([number.setdefault(w, len(number)) for w in words], np.int32)
                else:
                    get = number.get
                    own = np.array([get(w, -1) for w in words], np.int32)
                keep = np.flatnonzero(own >= 0).astype(np.int32)
                ids.append(doc_id)
                counts.append(len(words))
                seen.append(own[keep])
                at.append(keep + np.int32(where))
                where += len(words) + GAP
                if where >= SEGMENT_WORDS:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(segments, INDEX)


def pack(places: np.ndarray) -> bytes:
    """Ascending places as differences, in two bytes each where they fit, after a width byte."""
    steps = np.diff(places, prepend=0)
    width = "<u2" if not len(steps) or steps.max() < 1 << 16 else "<u4"
    return width[-1:].encode() + steps.astype(width).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, f"<u{chr(blob[0])}", offset=1), dtype=np.int64)


def search(index: DataFrame, texts: list[tuple[str | None, str | None]], length: int, near: int | None = None) -> DataFrame:
    """Per indexed document: merged word spans of exact phrase matches and the phrases' names.

    A phrase is ``length`` consecutive words of a text, or all words of a shorter one; its name is
    the text's. ``near_items``: names of phrases whose terms all occur within ``near`` (at most
    GAP) words, in any order. ``texts`` is a block whose size the caller bounds; phrases are cut
    from it where they are looked up.
    """
    spark = index.sparkSession
    if near is not None and near > GAP:
        raise ValueError(f"near is at most {GAP}")
    named: dict[str, set[str]] = {}
    for name, text in texts:
        named.setdefault(text or "", set()).update([] if name is None else [name])
    asked = spark.createDataFrame([(t,) for t in sorted({t for text in named for t in words_of(text)})], "term binary")
    frequency = {
        bytes(r["term"]): r["n"]
        for r in index.select(F.explode(F.arrays_zip("terms", "n_docs")).alias("e"))
        .groupBy(F.col("e.terms").alias("term"))
        .agg(F.sum("e.n_docs").alias("n"))
        .join(asked, "term", "left_semi")
        .toLocalIterator()
    }
    shared = spark.sparkContext.broadcast((frequency, [(text, sorted(names)) for text, names in named.items()]))

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = None
        for batch in batches:
            tests = tests or _Tests(*shared.value, length)
            for row in range(batch.num_rows):
                yield _in_segment({k: batch.column(k)[row].as_py() for k in batch.schema.names}, tests, near)

    return index.mapInArrow(matches, FOUND)


class _Tests:
    """Test texts as numbers of the terms that the corpus holds (-1: held nowhere)."""

    def __init__(self, frequency: dict[bytes, int], texts: list[tuple[str, list[str]]], length: int):
        self.terms = list(frequency)
        self.frequency = np.array([*frequency.values(), 0], np.int64)
        self.length = length
        number = {t: i for i, t in enumerate(self.terms)}
        cut = ((np.array([number.get(w, -1) for w in words_of(text)], np.int32), names) for text, names in texts)
        self.texts = [(own, names) for own, names in cut if len(own)]

    def phrases(self, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
        """Terms, offsets and names of each phrase all of whose terms are ``held``, rarest term first."""
        for own, names in self.texts:
            n = min(self.length, len(own))
            have = np.concatenate([[0], np.cumsum(held[own])])
            for i in np.flatnonzero(have[n:] - have[:-n] == n).tolist():
                phrase = own[i : i + n]
                order = np.argsort(self.frequency[phrase], kind="stable")
                yield phrase[order], order, names


def _in_segment(row: dict, tests: _Tests, near: int | None) -> pa.RecordBatch:
    where = {t: i for i, t in enumerate(row["terms"])}
    at_row = np.array([*(where.get(t, -1) for t in tests.terms), -1], np.int64)
    read: dict[int, np.ndarray] = {}

    def places(term: int) -> np.ndarray:
        if term not in read:
            read[term] = unpack(row["positions"][at_row[term]])
        return read[term]

    sizes = np.array(row["n_words"], np.int64)
    bases = np.concatenate([[0], np.cumsum(sizes + GAP)[:-1]]).astype(np.int64)
    cover = np.zeros(int((sizes + GAP).sum()) + 1, np.int32)
    items: list[set[str]] = [set() for _ in bases]
    close: list[set[str]] = [set() for _ in bases]
    for terms, offsets, names in tests.phrases(at_row >= 0):
        lists = [places(t) for t in terms.tolist()]
        starts = lists[0] - offsets[0]
        for other, offset in zip(lists[1:], offsets[1:].tolist()):
            if not len(starts):
                break
            wanted = starts + offset
            at = np.searchsorted(other, wanted)
            at[at == len(other)] = 0
            starts = starts[other[at] == wanted]
        if len(starts):
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + len(terms), -1)
            for d in set((np.searchsorted(bases, starts, "right") - 1).tolist()):
                items[d].update(names)
        if near is not None:
            for d in _close_documents([read[t] for t in dict.fromkeys(terms.tolist())], near, bases):
                close[d].update(names)
    covered = np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)])
    edges = np.diff(covered)
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(bases, first, "right") - 1
    spans: list[list[dict]] = [[] for _ in bases]
    for d, s, e in zip(owner.tolist(), (first - bases[owner]).tolist(), (last - bases[owner]).tolist()):
        spans[d].append({"start": s, "end": e})
    n = len(bases)
    columns = [[row["segment"]] * n, range(n), row["doc_ids"], row["n_words"], spans, map(sorted, items), map(sorted, close)]
    return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(columns, _FOUND)], schema=_FOUND)


def _close_documents(lists: list[np.ndarray], near: int, bases: np.ndarray) -> set[int]:
    """Documents with an interval of ``near`` words that holds a place of every list.

    ``lists`` come rarest first. The interval holds a place of the rarest list that has one of
    every other list less than ``near`` words away, and it can start at one of the places.
    """
    anchors = lists[0]
    for other in lists[1:]:
        at = np.searchsorted(other, anchors - near, "right")
        inside = at < len(other)
        anchors, at = anchors[inside], at[inside]
        anchors = anchors[other[at] - anchors < near]
        if not len(anchors):
            return set()
    starts = np.unique(np.concatenate([_before(own, anchors, near) for own in lists]))
    for other in lists:
        at = np.searchsorted(other, starts)
        inside = at < len(other)
        starts, at = starts[inside], at[inside]
        starts = starts[other[at] - starts < near]
    return set((np.searchsorted(bases, starts, "right") - 1).tolist())


def _before(own: np.ndarray, anchors: np.ndarray, near: int) -> np.ndarray:
    """Places of a list at an anchor or less than ``near`` words before it."""
    low = np.searchsorted(own, anchors - near, "right")
    sizes = np.searchsorted(own, anchors, "right") - low
    return own[np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10, near: int | None = None) -> DataFrame:
    """Per row of ``docs``: n_words, n_hit, the sorted ids of items with a phrase in it, spans.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored.
    Returns doc_id, n_words, n_hit, items array<string>, near_items array<string>,
    spans array<struct<start, end>> (word numbers, end exclusive).
    """
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_CHARS))
    tests = tests.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))

    def block(k: int) -> list:
        rows = tests.where(F.col("block") == k).select("item_id", "text").toLocalIterator()
        return [(r["item_id"], r["text"]) for r in rows]

    texts = block(0)
    vocabulary = {t for _, text in texts for t in words_of(text)} if blocks == 1 else None
    if vocabulary is not None and len(vocabulary) > MOST_TERMS:
        vocabulary = None
    index, _ = materialised(build_index(docs, vocabulary), "postings")
    found = search(index, texts, length, near)
    for k in range(1, blocks):
        found = found.unionByName(search(index, block(k), length, near))
    if blocks > 1:
        found = found.groupBy("segment", "ordinal").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
        )
    hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["end"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "items", "near_items", "spans")
