import numpy as np
import pytest

from feedloom.llm import toxicity
from tests.llm.conftest import prose

RUDE = ["grobblex", "grobblen", "snarfian"]


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = prose(int(rng.integers(5, 80)), int(rng.integers(1000))).split()
        toxic = int(rng.random() < 0.25)
        if toxic:
            words.insert(int(rng.integers(len(words))), RUDE[int(rng.integers(3))] + str(rng.integers(50)))
        rows.append((i, "the of and " + " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def learnt(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (3, None), (10**9, 1)], "doc_id bigint, toxic int")
    return toxicity.train(docs, labels)


def test_held_out_accuracy(spark, learnt):
    rows = corpus(400, seed=2)
    docs = spark.createDataFrame([(*r[:2], 0.5) for r in rows], "doc_id bigint, text string, n double")
    got = {r["doc_id"]: r["score"] for r in toxicity.with_score(docs, learnt).collect()}
    right = sum((got[i] >= toxicity.SCORE_THRESHOLD) == bool(t) for i, _, t in rows)
    assert right >= 0.97 * len(rows)
    assert all(0 <= s <= 1 for s in got.values())


def test_whole_texts_and_awkward_rows(docs, awkward, learnt):
    plain = docs.drop("score")
    got = toxicity.with_score(plain, learnt).collect()
    assert len(got) == len(awkward) and all(0 <= r["score"] < toxicity.SCORE_THRESHOLD for r in got)
    scorer = toxicity.Scorer(learnt)
    long = toxicity.words_of(prose(20_000, 3))
    assert scorer.scores([long])[0] < 0.7 <= scorer.scores([[*long, b"grobblex7"]])[0]
    with pytest.raises(ValueError):
        toxicity.with_score(docs, learnt)


def test_scored_once_equals_trained_and_scored(spark, awkward):
    """Also where columns have the names of those used inside, ids repeat, and the text goes."""
    rows = [(i, t, 1.0, "x") for i, t, _ in corpus(600)] + [(i, t, 2.0, "y") for i, t in awkward]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, logit double, language string").repartition(3)
    labels = spark.createDataFrame([(i, t) for i, _, t in corpus(600)] + [(None, 1)], "doc_id bigint, toxic int")
    want = toxicity.with_score(docs, toxicity.train(docs, labels)).collect()
    got = toxicity.score_documents(docs, labels)
    assert got.columns == ["doc_id", "text", "logit", "language", "score"]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["language"], r["text"] or "")
    for a, b in zip(sorted(got.collect(), key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a["score"] == pytest.approx(b["score"], abs=1e-5)
    assert toxicity.score_documents(docs, labels, text=False).columns == ["doc_id", "logit", "language", "score"]


def test_scores_do_not_depend_on_neighbours(learnt):
    texts = [toxicity.words_of(t) for _, t, _ in corpus(40, seed=5)] + [[], [b"grobblen1"]]
    alone = [toxicity.Scorer(learnt).scores([t])[0] for t in texts]
    assert np.allclose(toxicity.Scorer(learnt).scores(texts), alone, atol=1e-5)


def test_pooling_equals_a_loop(learnt):
    rng = np.random.default_rng(3)
    texts = [rng.normal(size=(n, toxicity.SIZE)).astype(np.float32) for n in (1, 2, 3, 17)]
    pad = np.zeros((max(toxicity.WIDTHS), toxicity.SIZE), np.float32)
    starts = np.cumsum([0, *[len(t) + len(pad) for t in texts]])[:-1]
    line = np.concatenate([x for t in texts for x in (t, pad)])
    pooled, _ = learnt.pooled(line, starts, np.array([len(t) for t in texts]))
    for row, t in zip(pooled, texts):
        whole, want = np.concatenate([t, pad]), []
        for width, taps, bias in zip(toxicity.WIDTHS, learnt.filters, learnt.bias):
            values = [sum(whole[p + j] @ taps[j] for j in range(width)) for p in range(len(t))]
            want.append(np.maximum(np.max(values, 0) + bias, 0))
        assert np.allclose(row, np.concatenate(want), atol=1e-4)


def test_without_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(docs, none)
    assert all(r["score"] < 0.01 for r in toxicity.with_score(docs.drop("score"), model).collect())
    assert toxicity.with_score(no_docs, toxicity.train(no_docs, none)).count() == 0


def test_thresholds_by_language():
    assert toxicity.language_of(b"der und das von".split()) == 1
    assert toxicity.language_of([]) == len(toxicity.FUNCTION_WORDS)
    raw, labels = np.array([3.0, 1.0, 0.5, -2.0]), np.array([1, 1, 0, 0])
    assert toxicity._threshold(raw, labels) == 0.75
    assert toxicity._threshold(raw, np.zeros(4)) is None


def test_thresholds_come_from_all_labelled_rows(spark):
    # German is rare: the sample holds too few toxic rows of it, the label table enough. A word
    # that is rude elsewhere is half a sign of it there.
    rng = np.random.default_rng(9)
    rows = []
    for i, text, toxic in corpus(4000, seed=3):
        if i % 20 == 0:
            text = "der und das von ist " + " ".join(w for w in text.split()[3:] if not w.startswith(tuple(RUDE)))
            toxic = int(rng.random() < 0.3)
            text += (" grobblex1" if toxic else "") + " snarfian2" * int(rng.random() < 0.5)
        rows.append((i, text, toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, sample=400)
    own = toxicity.counted(toxicity.with_logits(docs, model), labels.toDF("label_id", "toxic")).where("language = 1")
    assert own.agg({"n": "sum"}).first()[0] == 200
    assert model.shift[1] != model.shift[-1] and model.shift[0] != model.shift[-1]


def test_binned_thresholds_equal_those_of_rows():
    rng = np.random.default_rng(4)
    labels = (rng.random(3000) < 0.2).astype(int)
    raw = rng.normal(0, 2, 3000) + 3 * labels
    bins = np.floor((raw + toxicity.LIMIT) * toxicity.BINS).astype(int)
    got = toxicity._binned_threshold(bins, labels, np.ones(3000, int))
    scores = lambda cut: 2 * labels[raw >= cut].sum() / ((raw >= cut).sum() + labels.sum())
    assert scores(got) >= scores(toxicity._threshold(raw, labels)) - 0.005
    assert toxicity._binned_threshold(bins, np.zeros(3000, int), np.ones(3000, int)) is None
