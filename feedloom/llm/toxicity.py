"""Toxicity by a convolutional text classifier, trained here in numpy.

A word's embedding is the sum of hashed embeddings: of the word and of its beginnings, as far
as enough training texts hold them. Filters of several widths slide over the whole text, each
keeps its largest value, and a dense layer makes a logit of them. Training uses a bounded sample
of labelled rows, chosen by a hash of doc_id. All labelled rows that were not trained on, a quarter
of the sample among them, calibrate a threshold per language (told from the text's own function
words): they are scored where they lie, and counts by language, logit bin and label decide. Scores
are shifted so that every language's threshold is SCORE_THRESHOLD.

Only the text enters a score. Null and empty texts are scored as one unknown word. Labels that
are null or whose document is missing are ignored; without labels of both classes every score
is the share of toxic labels (close to 0 without any). Repeated rows are scored each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.llm.storage import materialised, unused

#: Labelled rows that may be collected to train on.
SAMPLE = 8_000
#: Logits are counted in bins of 1 / BINS between -LIMIT and LIMIT. Rows of either label that a
#: language needs for a threshold of its own.
BINS, LIMIT, LEAST_ROWS = 64, 40, 20
BUCKETS, LEAST_TEXTS = 1 << 22, 3
#: Bytes of a word's beginnings that are hashed beside the word.
BEGINNINGS = (3, 4, 5, 6, 7, 8, 10)
#: Words whose vectors a worker remembers.
REMEMBERED = 1 << 19
SIZE, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 64, 0.01
SCORE_THRESHOLD = 0.7

#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with was on are this be by from or",
    "de": "der die das und den von mit zu ist nicht ein eine auf im dem des sich auch",
    "fr": "le les des et une du dans pour est sur pas au avec qui ne aux il ce",
    "es": "el los las y en del por con una para es se su al lo como más pero",
}
_LANGUAGES = [*FUNCTION_WORDS, "other"]
_TELLS = {w.encode(): i for i, words in enumerate(FUNCTION_WORDS.values()) for w in words.split()}
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 or b > 0x7F else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def hashes(word: bytes) -> list[int]:
    """Buckets of the word and of its beginnings (-1 where it is too short)."""
    found = [zlib.crc32(word + b"$")] + [zlib.crc32(word[:n]) if len(word) >= n else None for n in BEGINNINGS]
    return [-1 if h is None else (h * 0x9E3779B1 >> 7) & (BUCKETS - 1) for h in found]


def language_of(words: list[bytes]) -> int:
    """Number of the language most of whose function words occur; the last is none."""
    votes = [0] * len(_LANGUAGES)
    for w in words:
        if (i := _TELLS.get(w)) is not None:
            votes[i] += 1
    best = max(votes)
    return votes.index(best) if best else len(_LANGUAGES) - 1


@dataclass
class Model:
    """Weights; ``slot`` maps a bucket to its embedding, 0 (always zero) for unknown ones."""

    slot: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    offset: float
    #: Logit shift per language.
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(_LANGUAGES)))

    def pooled(self, vectors: np.ndarray, starts: np.ndarray, sizes: np.ndarray, where: bool = False) -> tuple:
        """Largest filter values of each text, and their places if asked for."""
        out, at = [], []
        for width, taps, bias in zip(WIDTHS, self.filters, self.bias):
            n = len(vectors) - width + 1
            values = vectors[:n] @ taps[0]
            for j in range(1, width):
                values += vectors[j : n + j] @ taps[j]
            if where:
                at.append(np.array([values[s : s + k].argmax(0) + s for s, k in zip(starts, sizes)]))
                top = values[at[-1], np.arange(FILTERS)]
            else:
                # Windows that begin in a text's padding are not its own.
                edges = np.stack([starts, starts + sizes], 1).ravel()
                top = np.maximum.reduceat(np.concatenate([values, values[-1:]]), edges, axis=0)[::2]
            out.append(np.maximum(top + bias, 0))
        return np.concatenate(out, 1), at


class Scorer:
    """Scores texts with a model; remembers the vectors of words, up to a bounded number."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, int] = {}
        self.vectors = np.zeros((1024, SIZE), np.float32)

    def _rows(self, words: list[bytes]) -> list[int]:
        known = self.known
        rows = [known.get(w, -1) for w in words]
        if -1 in rows:
            for i, r in enumerate(rows):
                if r < 0 and (r := known.get(words[i], -1)) < 0:
                    r = known[words[i]] = len(known) + 1
                    if r >= len(self.vectors):
                        self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                    slots = self.model.slot[[h for h in hashes(words[i]) if h >= 0]]
                    self.vectors[r] = self.model.embedding[slots].sum(0)
                rows[i] = r
        return rows

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known, self.vectors = {}, np.zeros((1024, SIZE), np.float32)
        rows, starts, sizes = padded([self._rows(t) for t in texts])
        return self.model.pooled(self.vectors[rows], starts, sizes)[0] @ self.model.dense + self.model.offset

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        """Calibrated scores of tokenized texts."""
        return _sigmoid(self.logits(texts) + self.model.shift[[language_of(t) for t in texts]])


def padded(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' word numbers on end, each followed by zeros so that every filter fits; where
    they start, and their sizes (an empty text is one zero)."""
    pad, sizes = max(WIDTHS), np.array([max(1, len(t)) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + pad)])
    rows = np.zeros(starts[-1], np.int64)
    for t, s in zip(texts, starts):
        rows[s : s + len(t)] = t
    return rows, starts[:-1], sizes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Adam:
    def __init__(self, arrays: list[np.ndarray]):
        self.m, self.v, self.t = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays], 0

    def step(self, arrays: list[np.ndarray], grads: list[np.ndarray], rows: list) -> None:
        self.t += 1
        for a, g, r, m, v in zip(arrays, grads, rows, self.m, self.v):
            m[r] = 0.9 * m[r] + 0.1 * g
            v[r] = 0.999 * v[r] + 0.001 * g * g
            a[r] -= RATE * (m[r] / (1 - 0.9**self.t)) / (np.sqrt(v[r] / (1 - 0.999**self.t)) + 1e-6)


def fit(rows: list[np.ndarray], labels: np.ndarray, words: list[bytes], seed: int = 7) -> tuple[Model, np.ndarray]:
    """Train on texts given as numbers of ``words`` (from 1); embeddings start from log-odds of
    the labels. Also returns the slots of every number."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float64)
    buckets = np.full((len(words) + 1, 1 + len(BEGINNINGS)), -1, np.int32)
    for i, word in enumerate(words, 1):
        buckets[i] = hashes(word)
    counts = np.zeros((2, BUCKETS), np.int32)
    for r, y in zip(rows, labels):
        own = np.unique(buckets[np.unique(r)])
        counts[int(y)][own[own >= 0]] += 1
    known = np.flatnonzero(counts.sum(0) >= LEAST_TEXTS)
    slot = np.zeros(BUCKETS, np.int32)
    slot[known] = np.arange(1, len(known) + 1)
    slots = np.where(buckets >= 0, slot[buckets], 0).astype(np.int32)
    positive, negative = max(1.0, labels.sum()), max(1.0, len(labels) - labels.sum())
    odds = np.log((counts[1][known] + 0.5) / (positive + 1)) - np.log((counts[0][known] + 0.5) / (negative + 1))
    embedding = rng.normal(0, 0.02, (len(known) + 1, SIZE)).astype(np.float32)
    embedding[1:, 0] += np.clip(odds, -4, 4) / 16
    embedding[0] = 0
    filters = [rng.normal(0, 0.2, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for taps in filters:
        taps[0, 0, : FILTERS // 2] += 1.0
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-6, 1 - 1e-6))
    dense = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    model = Model(slot, embedding, filters, bias, dense, np.log(share / (1 - share)))
    if not 0 < labels.sum() < len(labels):
        model.dense[:] = 0
        return model, slots
    offset = np.array([model.offset], np.float32)
    arrays = [embedding, *filters, *bias, dense, offset]
    adam = _Adam(arrays)
    every = slice(None)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            own, starts, sizes = padded([rows[j] for j in batch])
            vectors = embedding[slots[own]].sum(1)
            pooled, at = model.pooled(vectors, starts, sizes, where=True)
            error = (_sigmoid(pooled @ dense + offset[0]) - labels[batch]) / len(batch)
            back = np.outer(error, dense) * (pooled > 0)
            places, steps, filter_grads, bias_grads = [], [], [], []
            for k, (width, taps) in enumerate(zip(WIDTHS, filters)):
                g = back[:, k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
                grad = np.empty_like(taps)
                for j in range(width):
                    grad[j] = np.einsum("bf,bfd->df", g, vectors[at[k] + j])
                    places.append(own[at[k] + j].ravel())
                    steps.append((g[:, :, None] * taps[j].T[None]).reshape(-1, SIZE))
                filter_grads.append(grad + 1e-4 * taps)
                bias_grads.append(g.sum(0))
            moved_slots = slots[np.concatenate(places)]
            touched, inverse = np.unique(moved_slots, return_inverse=True)
            moved = np.zeros((len(touched), SIZE), np.float32)
            np.add.at(moved, inverse.ravel(), np.repeat(np.concatenate(steps), moved_slots.shape[1], axis=0))
            moved[touched == 0] = 0
            grads = [moved, *filter_grads, *bias_grads, pooled.T @ error + 1e-4 * dense, np.array([error.sum()])]
            adam.step(arrays, grads, [touched] + [every] * (len(arrays) - 1))
    model.offset = float(offset[0])
    return model, slots


def calibrate(model: Model, languages: np.ndarray, bins: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> None:
    """Set the shift of each language, from counts of rows: its threshold of best F1 becomes
    SCORE_THRESHOLD."""
    goal = np.log(SCORE_THRESHOLD / (1 - SCORE_THRESHOLD))
    common = _binned_threshold(bins, labels, counts)
    for i in range(len(_LANGUAGES)):
        own = languages == i
        toxic = counts[own & (labels == 1)].sum()
        enough = min(toxic, counts[own].sum() - toxic) >= LEAST_ROWS
        cut = _binned_threshold(bins[own], labels[own], counts[own]) if enough else common
        model.shift[i] = 0.0 if cut is None else goal - cut


def _binned_threshold(bins: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> float | None:
    """The logit of best F1 between bins of rows, in the middle of the gap it lies in."""
    both = np.zeros((2, 2 * LIMIT * BINS + 1), np.int64)
    np.add.at(both, (labels, bins), counts)
    if not both.sum(1).all():
        return None
    used = np.flatnonzero(both.sum(0))[::-1]
    found = np.cumsum(both[1, used])
    f1 = 2 * found / (np.cumsum(both[:, used].sum(0)) + found[-1])
    best = int(np.argmax(f1))
    middle = (used + 0.5) / BINS - LIMIT
    return float(middle[best] + middle[best + 1]) / 2 if best + 1 < len(used) else float(middle[best]) - 1.0


def counted(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """language, bin, toxic, n of the rows of ``scored`` (doc_id, logit, language) that ``labels``
    (label_id, toxic) has; at most one row per language, bin and label."""
    rows = scored.select("doc_id", "language", _bin(F.col("logit")).alias("bin"))
    met = rows.join(labels, F.col("doc_id") == F.col("label_id"))
    return met.groupBy("language", "bin", "toxic").agg(F.count(F.lit(1)).alias("n"))


def _bin(logit: Column) -> Column:
    """The number of the bin that a logit falls in."""
    at = F.floor((logit + LIMIT) * BINS)
    return F.greatest(F.lit(0), F.least(F.lit(2 * LIMIT * BINS), at)).cast("int")


def _threshold(raw: np.ndarray, labels: np.ndarray) -> float | None:
    """The logit of best F1, in the middle of the gap it lies in."""
    if not 0 < labels.sum() < len(labels):
        return None
    order = np.argsort(-raw, kind="stable")
    raw, labels = raw[order], labels[order]
    found = np.cumsum(labels)
    f1 = 2 * found / (np.arange(1, len(raw) + 1) + labels.sum())
    f1[:-1][raw[1:] == raw[:-1]] = -1
    best = int(np.argmax(f1))
    return float(raw[best] + raw[best + 1]) / 2 if best + 1 < len(raw) else float(raw[best]) - 1.0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), fitted on at most about
    ``sample`` labelled rows, with thresholds from all others."""
    model, others = _fitted(docs, labels, sample)
    logits = with_logits(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), model)
    _calibrated(model, logits.drop("text"), others)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, name: str = "score", text: bool = True, sample: int = SAMPLE) -> DataFrame:
    """``docs`` (without its text, if so asked) with scores of a model trained on them, as ``name``.

    Like ``train`` and ``with_score``, but every text is read and scored once.
    """
    model, others = _fitted(docs, labels, sample)
    logit, language = (unused(docs, c) for c in ("logit", "language"))
    rows = with_logits(docs, model, logit, language)
    rows, _ = materialised(rows if text else rows.drop("text"), "logits")
    ids = F.col("doc_id").cast("bigint").alias("doc_id")
    _calibrated(model, rows.select(ids, F.col(logit).alias("logit"), F.col(language).alias("language")), others)
    shift = F.element_at(F.array(*[F.lit(float(x)) for x in model.shift]), F.col(language) + 1)
    limited = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col(logit) + shift))
    return rows.withColumn(name, 1 / (1 + F.exp(-limited))).drop(logit, language)


def _calibrated(model: Model, scored: DataFrame, others: DataFrame) -> None:
    """Set the model's thresholds from scored documents and the labels it was not trained on."""
    found = counted(scored, others).toArrow()
    if found.num_rows:
        calibrate(model, *(found.column(c).to_numpy() for c in ("language", "bin", "toxic", "n")))


def _fitted(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[Model, DataFrame]:
    """A model without thresholds, and the labels (label_id, toxic) that it was not trained on."""
    given = labels.where("toxic is not null and doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("label_id"), (F.col("toxic") != 0).cast("int").alias("toxic")
    )
    n = given.count()
    scale = 1 << 20
    dealt = F.pmod(F.xxhash64("label_id"), F.lit(scale))
    bound = int(scale * min(1.0, sample / max(1, n)))
    chosen = given.where(dealt < bound)
    quarter = F.pmod(F.xxhash64("label_id", F.lit("fold")), F.lit(4))
    texts_of = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    # Bounded by ``sample`` rows of two numbers.
    rows = texts_of.join(
        F.broadcast(chosen.select("label_id", "toxic", quarter.alias("fold"))), F.col("doc_id") == F.col("label_id")
    )

    table = rows.select("label_id", "text", "toxic", "fold").toArrow().sort_by("label_id")
    toxic, fold = table.column("toxic").to_numpy(), table.column("fold").to_numpy()
    number: dict[bytes, int] = {}
    texts = []
    for text in table.column("text"):
        words = words_of(text.as_py())
        texts.append(np.array([number.setdefault(w, len(number) + 1) for w in words], np.int32))
    del table
    few = len(texts) < 200
    train_on = np.flatnonzero((fold != 0) | few)
    model, _ = fit([texts[i] for i in train_on], toxic[train_on], list(number))
    # Of few rows all are trained on, and all calibrate.
    return model, given.where((dealt >= bound) | (quarter == 0) | F.lit(few)).select("label_id", "toxic")


def with_logits(docs: DataFrame, model: Model, logit: str = "logit", language: str = "language") -> DataFrame:
    """``docs`` with the logit and the language number of its text column appended."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts, logits, languages = batch.column(at), [np.empty(0)], []
            for i in range(0, batch.num_rows, 256):
                words = [words_of(t) for t in texts[i : i + 256].to_pylist()]
                logits.append(scorer.logits(words))
                languages += [language_of(t) for t in words]
            columns = [pa.array(np.concatenate(logits), pa.float64()), pa.array(languages, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, logit, language])

    return docs.mapInArrow(read, StructType([*docs.schema.fields]).add(logit, "double").add(language, "integer"))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of its text column appended as ``name``."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts, scores = batch.column(at), []
            for i in range(0, batch.num_rows, 256):
                words = [words_of(t) for t in texts[i : i + 256].to_pylist()]
                scores.append(scorer.scores(words))
            column = pa.array(np.concatenate(scores) if scores else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return docs.mapInArrow(read, StructType([*docs.schema.fields]).add(name, "double"))
