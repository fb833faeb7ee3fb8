import math
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import lm


@pytest.fixture(scope="module")
def text_rows():
    rng = np.random.default_rng(4)
    names, out = [f"w{i}" for i in range(40)], []
    for i in range(300):
        at, words = int(rng.integers(40)), []
        for _ in range(int(rng.integers(5, 60))):
            words.append(names[at])
            at = (at * 3 + 1) % 40 if rng.random() < 0.85 else int(rng.integers(40))
        out.append((i, " ".join(words)))
    return out


def test_counts_cover_everything(docs, awkward):
    want = Counter(w for _, t in awkward for w in lm.words_of(t))
    assert {bytes(r["word"]): r["n"] for r in lm.word_counts(docs).collect()} == dict(want)


def test_scores_equal_a_loop_over_words(docs, awkward, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 37)
    words = lm.vocabulary(docs)
    rng = np.random.default_rng(1)
    network = lm.Network([rng.normal(0, 0.3, a.shape).astype(np.float32) for a in lm.Network.start(words.prior).arrays])
    got = Counter((r["doc_id"], r["n_words"], round(r["pll"], 2)) for r in lm.scored(lm.encoded(docs, words), words, network).collect())
    want = Counter()
    for doc_id, text in awkward:
        ids = [int(i) for i in words.encode(lm.words_of(text))] if lm.words_of(text) else []
        total = 0.0
        for i, own in enumerate(ids):
            hidden = network.hidden.astype(float).copy()
            for table, j in zip(network.sides, lm._PLACES):
                hidden += table[ids[i + j] if 0 <= i + j < len(ids) else lm.PAD]
            logits = np.tanh(hidden) @ network.out + network.bias
            total += logits[words.group[own]] - math.log(np.exp(logits).sum()) + words.within[own]
        want[doc_id, len(ids), round(total, 2)] += 1
    close = sorted(got.elements(), key=str), sorted(want.elements(), key=str)
    assert len(close[0]) == len(close[1])
    for a, b in zip(*close):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 0.02 + 1e-4 * abs(b[2])


def test_probabilities_sum_to_one(docs):
    words = lm.vocabulary(docs)
    mass = np.bincount(words.group, np.exp(words.within), lm.CLASSES)
    assert np.allclose(mass[mass > 0], 1)


def test_training_beats_counts_on_held_out_text(spark, text_rows, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 64)
    docs = spark.createDataFrame(text_rows[:250], "doc_id bigint, text string").repartition(2)
    words = lm.vocabulary(docs)
    network = lm.trained(lm.encoded(docs, words), words)
    plain = lm.Network.start(words.prior)
    plain.sides = [s * 0 for s in plain.sides]
    ids, at, _ = lm.laid_out([words.encode(lm.words_of(t)).astype("<u2").tobytes() for _, t in text_rows[250:]])
    assert lm.log_probabilities(network, words, ids, at).mean() > lm.log_probabilities(plain, words, ids, at).mean() + 0.3


def test_awkward_and_empty(docs, awkward, no_docs):
    rows = lm.score_documents(docs).collect()
    assert len(rows) == len(awkward)
    assert all((r["pll"] == 0 and r["pll_per_word"] is None) == (r["n_words"] == 0) for r in rows)
    assert lm.score_documents(no_docs).count() == 0


def small_vocabulary(monkeypatch, size):
    for name, value in (("VOCABULARY", size), ("GROWTH", 0), ("OTHERS", 4), ("PLAIN", 8), ("ALONE", 5), ("SHARED", 2), ("OTHER_CLASSES", 2)):
        monkeypatch.setattr(lm, name, value, raising=False)


def test_vocabulary_grows_with_the_corpus(docs, monkeypatch):
    small_vocabulary(monkeypatch, 20)
    assert len(lm.vocabulary(docs).ids) == 20
    monkeypatch.setattr(lm, "GROWTH", 1)
    counts = Counter({bytes(r["word"]): r["n"] for r in lm.word_counts(docs).collect()})
    assert len(lm.vocabulary(docs).ids) == min(len(counts), math.isqrt(counts.total())) > 20


def test_every_word_has_a_share_of_its_own(spark, docs, monkeypatch):
    small_vocabulary(monkeypatch, 30)
    words = lm.vocabulary(docs)
    counts = {bytes(r["word"]): r["n"] for r in lm.word_counts(docs).collect()}
    assert len(counts) > 500
    start = lm.Network.start(words.prior, len(words.group), words.tree.odds)
    rng = np.random.default_rng(1)
    network = lm.Network([rng.normal(0, 0.3, a.shape).astype(np.float32) for a in start.arrays])
    ones = spark.createDataFrame([(i, w.decode()) for i, w in enumerate(counts)], "doc_id bigint, text string")
    got = {r["doc_id"]: math.exp(r["pll"]) for r in lm.scored(lm.encoded(ones, words), words, network).collect()}
    # Each bucket keeps a share of one word for words that the corpus lacks.
    unseen = sum(math.exp(r["pll"]) for r in lm.scored(lm.encoded(spark.createDataFrame([(0, w) for w in absent(words, counts)], "doc_id bigint, text string"), words), words, network).collect())
    assert abs(sum(got.values()) + unseen - 1) < 1e-3
    same = {}
    for i, (w, n) in enumerate(counts.items()):
        if w not in words.ids:
            same.setdefault(int(words.encode([w])[0]), set()).add(round(got[i] / n, 9))
    assert len(same) == 4 and all(max(s) - min(s) < 1e-6 for s in same.values())


def absent(words, counts):
    """One word of each bucket that the corpus lacks."""
    found = {}
    for i in range(1000):
        found.setdefault(int(words.encode([b"absent%d" % i])[0]), f"absent{i}")
    return found.values()


def test_start_is_the_shares_without_context(docs, monkeypatch):
    small_vocabulary(monkeypatch, 200)
    words = lm.vocabulary(docs)
    network = lm.Network.start(words.prior, len(words.group), words.tree.odds)
    own = np.arange(1, len(words.group))
    order, reach = words.tree.deepest_first(own)
    below = np.zeros(len(own))
    for level, m in enumerate(reach.tolist()):
        taken = network.branches(words.tree, words.tree.start[own[order[:m]]], level, np.ones((m, lm.SIZE), np.float32))[3]
        below[order[:m]] -= np.logaddexp(0, -taken)
    assert len(reach) and np.allclose(below, words.within[1:], atol=1e-4)


def test_words_on_a_line_are_those_of_each_text(awkward, monkeypatch):
    texts = [t for _, t in awkward]
    for portion in (1 << 23, 1):
        monkeypatch.setattr(lm, "PORTION", portion)
        got = [words.to_pylist()[a:b] for words, cuts in lm.words_on_line(texts) for a, b in zip(cuts, cuts[1:])]
        assert got == [lm.words_of(t) for t in texts]
    assert list(lm.words_on_line([])) == []


def test_class_odds_of_large_weights():
    rng = np.random.default_rng(2)
    network, hidden = lm.Network.start(np.zeros(9)), np.tanh(rng.normal(0, 2, (50, lm.SIZE))).astype(np.float32)
    for scale in (1, 40):
        network.out = rng.normal(0, scale, network.out.shape).astype(np.float32)
        odds, top, total = network.classes(hidden)
        logits = hidden @ network.out
        assert np.isfinite(odds).all() and np.allclose(top + np.log(total), np.logaddexp.reduce(logits.astype(float), 1), atol=1e-3)


def test_a_step_equals_the_gradient_of_the_scores(docs, monkeypatch):
    """Against finite differences of the summed log-probabilities, for every kind of weight."""
    small_vocabulary(monkeypatch, 200)
    monkeypatch.setattr(lm, "ROWS", 7)
    words = lm.vocabulary(docs)
    rng = np.random.default_rng(3)
    start = lm.Network.start(words.prior, len(words.group), words.tree.odds)
    start = lm.Network([a + rng.normal(0, 0.3, a.shape).astype(np.float32) for a in start.arrays])
    ids, at, _ = lm.laid_out([rng.integers(1, len(words.group), 40).astype(words.kind).tobytes() for _ in range(3)], words.kind)
    trainer = lm._Trainer(lm.Network([a.copy() for a in start.arrays]), words.group, words.tree)
    moves = []
    monkeypatch.setattr(trainer, "_move", lambda k, rows, g: moves.append((k % len(start.arrays), rows, g)))
    trainer.step(ids, at)
    for k, rows, g in moves:
        whole = np.zeros(start.arrays[k].shape)
        whole[rows] = g
        # Gradients of trees' nodes are sums, the others means.
        scale = 1 if k >= len(start.arrays) - 2 else len(at)
        way = rng.normal(0, 1, whole.shape)
        if k < len(lm._PLACES):
            way *= (np.arange(len(way)) != lm.PAD)[:, None]
        near = []
        for step in (-1e-2, 1e-2):
            arrays = [a.astype(np.float64) for a in start.arrays]
            arrays[k] = arrays[k] + step * way
            near.append(lm.log_probabilities(lm.Network(arrays), words, ids, at).sum())
        assert abs((near[0] - near[1]) / 2e-2 - scale * (whole * way).sum()) <= 0.02 * (1 + abs(scale * (whole * way).sum())), k


def topical(n, seed, swap=False):
    """Documents of one of 6 topics, each of 100 words of like frequency; ``swap`` exchanges some
    words for those of another topic with the same rank."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        topic = int(rng.integers(6))
        ranks = np.minimum(rng.geometric(0.03, 60) - 1, 99)
        other = (rng.random(60) < 0.3) * rng.integers(1, 6, 60)
        out.append((i, " ".join(f"t{(topic + (int(o) if swap else 0)) % 6}n{r}" for r, o in zip(ranks, other))))
    return out


def test_context_tells_words_of_one_class_apart(spark, monkeypatch):
    for name, value in (("CHUNK", 256), ("PLAIN", 64), ("ALONE", 8), ("SHARED", 2)):
        monkeypatch.setattr(lm, name, value, raising=False)
    docs = spark.createDataFrame(topical(4000, 1), "doc_id bigint, text string").repartition(2)
    words = lm.vocabulary(docs)
    network = lm.trained(lm.encoded(docs, words).coalesce(2), words)
    ids, at, _ = lm.laid_out([words.encode(lm.words_of(t)).astype("<u2").tobytes() for _, t in topical(200, 2)])
    class_only = lm.Network([a.copy() for a in network.arrays])
    class_only.nodes[:] = 0
    class_only.odds[:] = words.tree.odds
    whole, shares = (lm.log_probabilities(n, words, ids, at).mean() for n in (network, class_only))
    swapped, places, _ = lm.laid_out([words.encode(lm.words_of(t)).astype("<u2").tobytes() for _, t in topical(200, 2, True)])
    assert whole > shares + 0.3
    assert lm.log_probabilities(network, words, swapped, places).mean() < whole - 0.3


class Rows(np.ndarray):
    """Weights of which rows are taken by ``take``, which copies whole rows, not by an index array."""

    def __getitem__(self, key):
        assert not isinstance(key, np.ndarray)
        return super().__getitem__(key)


def test_steps_take_whole_rows(docs, monkeypatch):
    small_vocabulary(monkeypatch, 200)
    words = lm.vocabulary(docs)
    start = lm.Network.start(words.prior, len(words.group), words.tree.odds)
    ids, at, _ = lm.laid_out([np.random.default_rng(5).integers(1, len(words.group), 60).astype(words.kind).tobytes()], words.kind)
    plain, watched = (lm._Trainer(lm.Network([a.copy() for a in start.arrays]), words.group, words.tree) for _ in range(2))
    watched.sums = [s.view(Rows) for s in watched.sums]
    for _ in range(2):
        plain.step(ids, at)
        watched.step(ids, at)
    assert all((a == b).all() and (a != c).any() for a, b, c in zip(plain.network.arrays, watched.network.arrays, start.arrays))
