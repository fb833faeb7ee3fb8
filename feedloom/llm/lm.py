"""Document scores of a masked language model: pseudo-log-likelihoods.

A small network predicts every word from REACH words on either side of it: each side's places
have embeddings of their own, their sum goes through a hidden layer to a softmax over classes,
and from a class down a binary tree to the word, where the same hidden layer decides every branch
(the most frequent words are classes of their own, and a small vocabulary has no other classes).
The vocabulary grows with the square root of the corpus. Other words are predicted up to a hash
bucket, a leaf of a tree, and have in it the share of their own count, which a join brings; so
the probabilities of all words sum to one. Word counts, training and scoring cover every word of
every document. Training is local: each trainer learns from its own part of the encoded corpus,
first from a share of the words, then from the rest, and the weights are averaged by words after
each round in streaming sums. A document's score is the sum of its words' conditional
log-probabilities.

Null and empty texts, and texts without letters or digits, have no words: their score is 0 and
the score per word null. Repeated rows are scored each. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from feedloom.llm.storage import forget, materialised

#: Least vocabulary, and its words for every square root of a word of the corpus; hash buckets of
#: other words.
VOCABULARY, GROWTH, OTHERS = 8192, 4, 1024
#: Words that are classes of their own, classes of other words and of buckets. Up to PLAIN words
#: and buckets all are classes of their own.
ALONE, SHARED, OTHER_CLASSES = 96, 24, 8
PLAIN = 4096
REACH, SIZE = 2, 16
RATE, CHUNK, WARM = 0.08, 8192, 8
#: Words whose class odds are held at a time, and bytes of text that are cut at a time.
ROWS, PORTION = 1024, 1 << 23
#: Numbers of a block of weights that travels as one row; least words of the corpus for every word
#: of the vocabulary and trainer, where there are more trainers than cores.
BLOCK, SHARE = 1 << 14, 256

CLASSES = ALONE + SHARED + OTHER_CLASSES
PAD = 0
_PLACES = [j for j in range(-REACH, REACH + 1) if j]
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 or b > 0x7F else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def words_on_line(texts: list[str | None]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The words of all texts in order, and where each text's begin (and the last one's end), in
    portions of texts."""
    held, size = [], 0
    for text in texts:
        held.append(text.lower().encode("utf-8", "surrogatepass") if text else b"")
        size += len(held[-1])
        if size >= PORTION:
            yield _cut(held)
            held, size = [], 0
    if held:
        yield _cut(held)


def _cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    line = np.frombuffer(b" ".join([b"", *texts, b""]).translate(_LETTERS), np.uint8)
    inside = line != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(line[inside])])
    places = np.cumsum([1] + [len(t) + 1 for t in texts])
    return words, np.searchsorted(begin, places)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents, counted per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [words for words, _ in words_on_line(batch.column(0).to_pylist())]
            seen = pa.chunked_array(lines, pa.binary()).value_counts()
            yield pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], ["word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """Binary trees below the classes: of every id, the nodes from its class down and the side it
    takes at each (from ``start[id]`` on), and of every node the log-odds of its right side."""

    start: np.ndarray
    nodes: np.ndarray
    sides: np.ndarray
    odds: np.ndarray

    @classmethod
    def over(cls, classes: list[np.ndarray], mass: np.ndarray) -> Tree:
        """Every class cut where its mass halves, and so on down to its ids."""
        parents, turns, odds = [], [], []
        at, turn = np.full(len(mass), -1), np.zeros(len(mass), np.float32)
        for members in classes:
            sums = [0.0, *np.cumsum(mass[members]).tolist()]
            todo = [(0, len(members), -1, 0.0)] if len(members) else []
            while todo:
                a, b, parent, side = todo.pop()
                if b - a == 1:
                    at[members[a]], turn[members[a]] = parent, side
                    continue
                cut = bisect_left(sums, (sums[a] + sums[b]) / 2, a + 1, b - 1)
                node = len(parents)
                parents.append(parent)
                turns.append(side)
                odds.append(math.log((sums[b] - sums[cut]) / (sums[cut] - sums[a])))
                todo += [(a, cut, node, -1.0), (cut, b, node, 1.0)]
        parents, turns = np.array(parents, np.int64), np.array(turns, np.float32)
        steps = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        while len(own := np.flatnonzero(at >= 0)):
            steps.append((own, at[own], turn[own]))
            turn[own], at[own] = turns[at[own]], parents[at[own]]
        of, nodes, sides = (np.concatenate(c) for c in zip(*steps))
        order = np.argsort(of, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(mass)))])
        return cls(start, nodes[order].astype(np.int32), sides[order], np.array(odds))

    def deepest_first(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the ids by their depths, and how many of them reach each level."""
        depth = (self.start[ids + 1] - self.start[ids]).astype(np.uint16)
        order = np.argsort(depth, kind="stable")[::-1]
        return order, len(ids) - np.cumsum(np.bincount(depth))[:-1]


@dataclass
class Vocabulary:
    """Ids of the frequent words (after PAD and the buckets); class of every id, and its
    log-probability within it without context."""

    ids: dict[bytes, int]
    group: np.ndarray
    within: np.ndarray
    prior: np.ndarray
    tree: Tree
    #: Words of the corpus, log-mass of the buckets, and the table of the counts of their words.
    total: int
    bucket: np.ndarray
    rest: str | None

    @property
    def kind(self) -> str:
        return "<u2" if len(self.group) <= 1 << 16 else "<u4"

    @cached_property
    def listed(self) -> pa.Array:
        return pa.array(list(self.ids), pa.binary())

    def encode(self, words: list[bytes]) -> np.ndarray:
        return self.looked_up(pa.array(words, pa.binary()))[0]

    def looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, and which of them have none of their own but their bucket's."""
        words = words.dictionary_encode()
        found = pc.index_in(words.dictionary, value_set=self.listed)
        absent = found.is_null().to_numpy(zero_copy_only=False)
        buckets = len(self.bucket)
        ids = pc.fill_null(found, 0).to_numpy() + np.int64(1 + buckets)
        ids[absent] = [1 + zlib.crc32(w) % buckets for w in words.dictionary.filter(pa.array(absent)).to_pylist()]
        at = words.indices.to_numpy()
        return ids.astype(self.kind)[at], absent[at]


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The vocabulary of a corpus, from counts over all of it."""
    counts, path = materialised(word_counts(docs), "word-counts")
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("words")).first()
    size = max(VOCABULARY, int(GROWTH * math.sqrt(seen["n"])))
    top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    words = [(bytes(r["word"]), r["n"]) for r in top]
    rest, buckets = None, 1
    if seen["words"] > len(words):
        # The last word of the vocabulary and its order tell which words are in it.
        others, rest = materialised(counts.where(_after(words[-1])), "other-counts")
        buckets = OTHERS
    first = 1 + buckets
    ids = {w: first + i for i, (w, _) in enumerate(words)}
    mass = np.ones(first + len(words))
    mass[PAD] = 0
    mass[first:] += [n for _, n in words]
    if rest:
        bucket = F.pmod(F.crc32("word"), F.lit(buckets)).alias("bucket")
        for r in others.groupBy(bucket).agg(F.sum("n").alias("n")).collect():
            mass[1 + r["bucket"]] += r["n"]
    forget(docs.sparkSession, path)
    if len(mass) - 1 <= PLAIN:
        group = np.maximum(np.arange(len(mass)) - 1, 0)
    else:
        group = np.empty(len(mass), np.int64)
        group[:first] = ALONE + SHARED + np.arange(first) % OTHER_CLASSES
        group[first:] = np.arange(len(words))
        # The other words by rank, in classes of like mass.
        below = np.cumsum(mass[first + ALONE :])
        group[first + ALONE :] = ALONE + np.minimum(below * SHARED // below[-1:], SHARED - 1) if len(below) else 0
    order = np.argsort(group[1:], kind="stable") + 1
    tree = Tree.over(np.split(order, np.flatnonzero(np.diff(group[order])) + 1), mass)
    total = np.bincount(group, mass)
    within = np.log(np.maximum(mass, 1e-300) / np.maximum(total, 1e-9)[group])
    prior = np.log(np.maximum(total, 1e-9) / mass.sum())
    return Vocabulary(ids, group, within, prior, tree, seen["n"], np.log(mass[1:first]), rest)


def _after(last: tuple[bytes, int]):
    word, n = last
    return (F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > F.lit(word)))


def encoded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """doc_id, the ids of all words (16 bits each, or 32 for a large vocabulary), the words that
    have none of their own, and a number of the row."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            done = 0
            for words, cuts in words_on_line(batch.column(1).to_pylist()):
                n = len(cuts) - 1
                ids, absent = known.looked_up(words)
                if not known.rest:
                    absent[:] = False
                before = np.concatenate([[0], np.cumsum(absent)])[cuts].astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(before), words.filter(pa.array(absent)))
                own = pa.array([ids[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist())], pa.binary())
                columns = [batch.column(0).slice(done, n), own, others, pa.array(range(row, row + n), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "others", "row"])
                done, row = done + n, row + n

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        encode, "doc_id bigint, ids binary, others array<binary>, row bigint"
    )


class Network:
    """Embeddings per place, hidden bias, output weights and bias of the classes, and weights and
    bias of the trees' nodes; all float32."""

    def __init__(self, arrays: list[np.ndarray]):
        self.sides, (self.hidden, self.out, self.bias, self.nodes, self.odds) = arrays[: len(_PLACES)], arrays[len(_PLACES) :]
        self.arrays = arrays

    @classmethod
    def start(cls, prior: np.ndarray, ids: int | None = None, odds: np.ndarray | None = None, seed: int = 5) -> Network:
        """By default every class is one id and there are no trees."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.05, shape).astype(np.float32)
        sides = [draw(ids or len(prior) + 1, SIZE) for _ in _PLACES]
        odds = np.zeros(0, np.float32) if odds is None else odds.astype(np.float32)
        nodes = np.zeros((len(odds), SIZE), np.float32)
        return cls([*sides, np.zeros(SIZE, np.float32), draw(SIZE, len(prior)), prior.astype(np.float32), nodes, odds])

    def context(self, ids: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Context ids and hidden values at the places."""
        around = [ids.take(at + j, mode="clip") for j in _PLACES]
        total = self.hidden + self.sides[0].take(around[0], 0, mode="clip")
        for table, near in zip(self.sides[1:], around[1:]):
            total += table.take(near, 0, mode="clip")
        return around, np.tanh(total, out=total)

    def classes(self, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row, the classes' odds, the logit from which they count, and their sum."""
        odds = hidden @ self.out
        odds += self.bias
        top = np.zeros((len(odds), 1), odds.dtype)
        # Hidden values are at most one: mostly no logit can be too large for its power of e.
        if (np.abs(self.out).sum(0) + np.abs(self.bias)).max(initial=0) > 64:
            top = odds.max(1, keepdims=True)
            odds -= top
        np.exp(odds, out=odds)
        return odds, top[:, 0], odds @ np.ones(odds.shape[1], np.float32)

    def branches(self, tree: Tree, first: np.ndarray, level: int, hidden: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nodes of a level on the ways that start at ``first`` in the tree, their weights, the
        sides taken and the logits of these."""
        at = first + level
        nodes, sides = tree.nodes.take(at, mode="clip"), tree.sides.take(at, mode="clip")
        weights = self.nodes.take(nodes, 0, mode="clip")
        return nodes, weights, sides, sides * (np.einsum("mk,mk->m", weights, hidden) + self.odds.take(nodes, mode="clip"))

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays])

    def loaded(self, flat: np.ndarray) -> Network:
        cuts = np.cumsum([a.size for a in self.arrays])[:-1]
        return Network([p.reshape(a.shape).astype(np.float32) for p, a in zip(np.split(flat, cuts), self.arrays)])


def laid_out(docs: list[bytes], kind: str = "<u2") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' ids on one line with padding between them; the words' places; document sizes."""
    sizes = np.array([len(d) // np.dtype(kind).itemsize for d in docs], np.int64)
    starts = REACH + np.concatenate([[0], np.cumsum(sizes + REACH)])
    ids = np.full(starts[-1] + REACH, PAD, np.int64)
    at = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    if len(at):
        ids[at] = np.frombuffer(b"".join(docs), kind)
    return ids, at, sizes


class _Trainer:
    """Adagrad on one trainer's words; only the rows that a step meets move."""

    def __init__(self, network: Network, group: np.ndarray, tree: Tree):
        self.network, self.group, self.tree = network, group, tree
        self.sums = [np.full(a.shape, 1e-3, np.float32) for a in network.arrays[:-2]]
        # Gradients of nodes are sums, not means.
        self.sums += [np.full(a.shape, 1.0, np.float32) for a in network.arrays[-2:]]
        most = max(len(group), len(tree.odds))
        self.met, self.number = np.zeros(most, bool), np.zeros(most, np.int64)

    def step(self, ids: np.ndarray, at: np.ndarray) -> None:
        net, n = self.network, len(at)
        order, reach = self.tree.deepest_first(ids[at])
        at = at[order]
        own = ids[at]
        around, hidden = net.context(ids, at)
        back, out, bias = np.empty_like(hidden), np.zeros_like(net.out), np.zeros_like(net.bias)
        group = self.group[own]
        for i in range(0, n, ROWS):
            part = hidden[i : i + ROWS]
            error, _, total = net.classes(part)
            error /= total[:, None]
            error[np.arange(len(part)), group[i : i + ROWS]] -= 1
            np.matmul(error, net.out.T, out=back[i : i + ROWS])
            out += part.T @ error
            bias += error.sum(0)
        if len(reach):
            # By columns, as counts with weights want them.
            first, columns = self.tree.start[own[: reach[0]]], hidden[: reach[0]].T.astype(np.float64)
            met, grads = [], np.empty((SIZE + 1, reach.sum()))
            done = 0
            for level, m in enumerate(reach.tolist()):
                nodes, weights, sides, taken = net.branches(self.tree, first[:m], level, hidden[:m])
                wrong = -sides / (1 + np.exp(np.minimum(taken, 60)))
                weights *= wrong[:, None]
                back[:m] += weights
                grads[SIZE, done : done + m] = wrong
                np.multiply(columns[:, :m], grads[SIZE, done : done + m], out=grads[:SIZE, done : done + m])
                met.append(nodes)
                done += m
            touched, sums = self._met(np.concatenate(met), grads)
            self._move(-2, touched, np.ascontiguousarray(sums[:, :SIZE]))
            self._move(-1, touched, np.ascontiguousarray(sums[:, SIZE]))
        back *= (1 - hidden * hidden) / np.float32(n)
        columns = back.T.astype(np.float64, order="C")
        for k, near in enumerate(around):
            self._move(k, *self._met(near, columns))
        for k, g in enumerate([back.sum(0), out / np.float32(n), bias / np.float32(n)], len(around)):
            self._move(k, slice(None), g)

    def _met(self, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct rows, and the sums of their values (given by columns)."""
        self.met[rows] = True
        touched = np.flatnonzero(self.met)
        self.met[touched] = False
        self.number[touched] = np.arange(len(touched))
        place = self.number.take(rows, mode="clip")
        sums = np.empty((len(columns), len(touched)), np.float32)
        for k, v in enumerate(columns):
            sums[k] = np.bincount(place, v, len(touched))
        return touched, np.ascontiguousarray(sums.T)

    def _move(self, k: int, rows, g: np.ndarray) -> None:
        sums, weights = self.sums[k], self.network.arrays[k]
        s = g * g
        s += self._at(sums, rows)
        sums[rows] = s
        np.sqrt(s, out=s)
        np.divide(g, s, out=s)
        s *= RATE
        np.subtract(self._at(weights, rows), s, out=s)
        weights[rows] = s

    @staticmethod
    def _at(values: np.ndarray, rows) -> np.ndarray:
        return values[rows] if isinstance(rows, slice) else values.take(rows, 0, mode="clip")


def _trained(corpus: DataFrame, words: Vocabulary, network: Network, warm: bool) -> DataFrame:
    """Blocks of each trainer's weights, with its number of words."""
    sc = corpus.sparkSession.sparkContext
    shared = sc.broadcast((words.group, words.tree, words.kind, network.arrays))
    trainers = max(sc.defaultParallelism, words.total // (SHARE * len(words.group)))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tree, kind, arrays = shared.value
        trainer, n, number = _Trainer(Network([a.copy() for a in arrays]), group, tree), 0, 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), 1024):
                ids, at, _ = laid_out(texts[i : i + 1024], kind)
                for j in range(0, len(at), CHUNK):
                    if (number % WARM == 0) == warm:
                        trainer.step(ids, at[j : j + CHUNK])
                        n += len(at[j : j + CHUNK])
                    number += 1
        if n:
            flat = trainer.network.flat()
            blocks = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            salt = TaskContext.get().partitionId() % 8
            yield _blocks([(i, salt, n, b) for i, b in enumerate(blocks)])

    return corpus.select("ids").coalesce(trainers).mapInArrow(train, "block int, salt int, n bigint, weights binary")


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["block", "salt", "n", "weights"])


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Means by words of blocks that the keys bring together, one running sum per block and task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: Counter = Counter()
        for batch in batches:
            for block, n, weights in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                values = np.frombuffer(weights, np.float32).astype(np.float64) * n
                sums[block] = sums[block] + values if block in sums else values
                counts[block] += n
        yield _blocks([(b, 0, counts[b], (v / counts[b]).astype(np.float32).tobytes()) for b, v in sums.items()])

    return rows.repartition(*keys).mapInArrow(add, "block int, salt int, n bigint, weights binary")


def trained(corpus: DataFrame, words: Vocabulary) -> Network:
    """The network after a warm round on a share of the chunks and a round on the others."""
    network = Network.start(words.prior, len(words.group), words.tree.odds)
    for warm in (True, False):
        total = _summed(_summed(_trained(corpus, words, network, warm), "block", "salt"), "block")
        # As many rows as the network has blocks.
        rows = sorted(total.toArrow().to_pylist(), key=lambda r: r["block"])
        if rows:
            network = network.loaded(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in rows]))
    return network


def log_probabilities(network: Network, words: Vocabulary, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the words at the places (of the buckets of words without ids), given those around them."""
    out, group, tree = np.empty(len(at)), words.group, words.tree
    rows = np.ascontiguousarray(network.out.T)
    for i in range(0, len(at), CHUNK):
        order, reach = tree.deepest_first(ids[at[i : i + CHUNK]])
        places = at[i : i + CHUNK][order]
        own = ids[places]
        _, hidden = network.context(ids, places)
        logs = np.empty(len(own))
        for j in range(0, len(own), ROWS):
            part, classes = hidden[j : j + ROWS], group[own[j : j + ROWS]]
            _, top, total = network.classes(part)
            mine = np.einsum("mk,mk->m", part, rows.take(classes, 0, mode="clip")) + network.bias[classes]
            logs[j : j + ROWS] = mine - top - np.log(total)
        first = tree.start[own]
        for level, m in enumerate(reach.tolist()):
            taken = network.branches(tree, first[:m], level, hidden[:m])[3]
            # log(1 + exp(-taken)), which does not overflow.
            logs[:m] -= np.maximum(-taken, 0) + np.log1p(np.exp(-np.abs(taken)))
        out[i + order] = logs
    return out


def scored(corpus: DataFrame, words: Vocabulary, network: Network) -> DataFrame:
    """doc_id, n_words, pll, pll_per_word."""
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast((words, network.arrays))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, arrays = shared.value
        net, first = Network(arrays), 1 + len(known.bucket)
        mass = np.concatenate([[0.0], known.bucket])
        for batch in batches:
            texts, sums, counts = batch.column(1).to_pylist(), [], []
            for i in range(0, len(texts), 1024):
                ids, at, sizes = laid_out(texts[i : i + 1024], known.kind)
                own = ids[at]
                logs = log_probabilities(net, known, ids, at) - np.where(own < first, mass[np.minimum(own, first - 1)], 0)
                total = np.concatenate([[0.0], np.cumsum(logs)])
                ends = np.cumsum(sizes)
                sums.append(total[ends] - total[ends - sizes])
                counts.append(sizes)
            values = [pa.array(np.concatenate(c) if c else [], k) for c, k in ((counts, pa.int64()), (sums, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values, *batch.columns[2:]], ["doc_id", "n_words", "pll", *batch.schema.names[2:]])

    if not words.rest:
        rows = corpus.select("doc_id", "ids").mapInArrow(score, "doc_id bigint, n_words bigint, pll double")
        return rows.withColumn("pll_per_word", F.try_divide("pll", "n_words"))
    # Shares of the words without ids within their buckets, by their own counts; one that the
    # corpus lacks counts as one.
    met = corpus.select("row", F.explode("others").alias("word"))
    counts = spark.read.schema("word binary, n bigint").parquet(words.rest)
    own = met.join(counts, "word", "left").groupBy("row").agg(F.sum(F.log(F.coalesce("n", F.lit(1)).cast("double"))).alias("own"))
    rows = corpus.select("doc_id", "ids", "row").mapInArrow(score, "doc_id bigint, n_words bigint, pll double, row bigint")
    pll = (F.col("pll") + F.coalesce("own", F.lit(0.0))).alias("pll")
    return rows.join(own, "row", "left").select("doc_id", "n_words", pll, F.try_divide(pll, "n_words").alias("pll_per_word"))


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` (doc_id, text) and score each of its rows."""
    words = vocabulary(docs)
    corpus, _ = materialised(encoded(docs, words), "encoded")
    return scored(corpus, words, trained(corpus, words))
