import random
import re
from collections import Counter

import pytest

from feedloom.llm import contamination
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, length=10):
    windows = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - length + 1) if own else 0):
            windows.setdefault(tuple(own[i : i + length]), set()).add(item)
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for w, names in windows.items():
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found |= {str(n) for n in names if n is not None}
        out.append((doc_id, len(own), len(hit), tuple(sorted(found))))
    return Counter(out)


ITEMS = [
    (1, prose(25, 5)),
    (1, prose(25, 5)),
    (2, "TWO words!"),
    (3, None),
    (4, ""),
    (10, prose(12, 1)),
    (None, prose(14, 9)),
    (20, prose(10, 5)),
]


def found(df):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect())


@pytest.mark.parametrize("setting", [{}, {"SEGMENT_WORDS": 50}, {"BLOCK_CHARS": 100}, {"MOST_TERMS": 3}])
def test_equals_brute_force(spark, docs, awkward, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(contamination, name, value)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert found(contamination.decontaminate(docs, items)) == brute(awkward, ITEMS)


def test_empty_tables(spark, docs, no_docs, awkward):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert contamination.decontaminate(no_docs, items).count() == 0
    assert found(contamination.decontaminate(docs, items.limit(0))) == brute(awkward, [])


def test_spans_and_proximity(spark):
    rows = [(1, "x alpha beta gamma y"), (2, "gamma x beta x alpha"), (3, "alpha beta " + "x " * 30 + "gamma"), (4, "alpha")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in contamination.decontaminate(docs, items, near=5).collect()}
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(1, 4)]
    assert {i: r["items"] for i, r in got.items()} == {1: ["7"], 2: [], 3: [], 4: []}
    assert {i: r["near_items"] for i, r in got.items()} == {1: ["7"], 2: ["7"], 3: [], 4: []}


def brute_near(docs, items, length, near):
    out = []
    for doc_id, text in docs:
        own, found = words(text), set()
        for item, phrases in items:
            asked = words(phrases)
            for i in range(max(1, len(asked) - length + 1) if asked else 0):
                window = set(asked[i : i + length])
                if any(window <= set(own[j : j + near]) for j in range(len(own))):
                    found.add(str(item))
        out.append((doc_id, tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize(
    "length, near, setting",
    [(1, 1, {}), (3, 3, {}), (3, 6, {"SEGMENT_WORDS": 90, "BLOCK_CHARS": 150}), (4, 20, {"SEGMENT_WORDS": 90}), (10, 64, {})],
)
def test_proximity_equals_brute_force(spark, monkeypatch, setting, length, near):
    """Shuffled, stretched and repeated words, in documents that share an axis."""
    for name, value in setting.items():
        monkeypatch.setattr(contamination, name, value)
    rng = random.Random(length * 100 + near)
    letters = [f"w{i}" for i in range(6)]
    rows = [(i, " ".join(rng.choice([*letters, "x", "y", "z"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    tests = [(i, " ".join(rng.choices(letters, k=rng.randrange(14)))) for i in range(12)]
    tests += [(99, "w0 nowhere w1"), (98, None), (97, tests[3][1])]
    rows += [(70, None), (71, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    items = spark.createDataFrame(tests, "item_id bigint, text string")
    got = contamination.decontaminate(docs, items, length, near).collect()
    assert Counter((r["doc_id"], tuple(r["near_items"])) for r in got) == brute_near(rows, tests, length, near)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == brute(rows, tests, length)


def test_lists_survive_packing():
    import numpy as np

    for places in ([], [0], [3, 4, 70000, 70001], list(range(0, 400000, 70000))):
        assert contamination.unpack(contamination.pack(np.array(places, np.int32))).tolist() == places
