import hashlib
from collections import Counter

import pytest

from feedloom.llm import substrings


def brute(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    last = float("inf")
    ranks = [last if i is None else i for i, _ in rows]
    first = {}
    for r, w in zip(ranks, words):
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, last), r)
    out = Counter()
    for (i, _), r, w in zip(rows, ranks, words):
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < r:
                gone.update(range(k, k + length))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length, minimiser", [(50, 10), (5, 2), (3, 3)])
@pytest.mark.parametrize("setting", [{}, {"MOST_STRINGS": 1, "MOST_WINDOWS": 4, "MOST_BITS": 64}])
def test_equals_brute_force(docs, awkward, monkeypatch, length, minimiser, setting):
    for name, value in setting.items():
        monkeypatch.setattr(substrings, name, value)
    rows = substrings.remove_repeats(docs, length, minimiser).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == brute(awkward, length)
    for r in rows:
        assert r["kept"] is None or hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_runs_cover_every_window_once():
    words = [b"%d" % (i * i % 31) for i in range(400)]
    for length, minimiser in ((50, 10), (5, 5), (2, 1)):
        _, starts, sizes = substrings.super_windows(words, length, minimiser)
        assert [s for a, k in zip(starts, sizes) for s in range(a, a + k)] == list(range(400 - length + 1))
    assert not len(substrings.super_windows(words[:3], 4, 2)[0])


def test_empty_table(no_docs):
    assert substrings.remove_repeats(no_docs).count() == 0
