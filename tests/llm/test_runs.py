import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from feedloom.llm import runs
from tests.llm.conftest import prose


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def brute_runs(words, exponent=4, least=6):
    """Every stretch that keeps its smallest period and that no neighbour extends."""
    n, found = len(words), set()
    for q in range(1, n):
        for x in range(n):
            if x > 0 and x - 1 + q < n and words[x - 1] == words[x - 1 + q]:
                continue
            y = x + q
            while y < n and words[y] == words[y - q]:
                y += 1
            if q <= y - x <= n - x and y - x >= max(least, exponent * q) and smallest_period(words[x:y]) == q:
                found.add((x, y - x, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = (g % n), 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words) if n < 500 else fast_runs(words)
    dropped = {i for x, length, q in found for i in range(x + q, x + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id,
        len(found),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def fast_runs(words, exponent=4, least=6):
    """For long lists: stretches by period, smallest first, so that a stretch keeps its first name."""
    n, found, at = len(words), {}, np.unique(np.array(words), return_inverse=True)[1]
    for q in range(1, n // exponent + 1):
        same = np.r_[False, at[q:] == at[:-q], False].astype(np.int8)
        for x, y in np.flatnonzero(np.diff(same)).reshape(-1, 2).tolist():
            if y + q - x >= max(least, exponent * q):
                found.setdefault((x, y + q), q)
    return sorted(((x, y - x, q) for (x, y), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("multiplier", [runs.MULTIPLIER, 1])
def test_catchers_equal_brute_force_however_words_are_appended(monkeypatch, multiplier):
    """With multiplier 1 most hashes collide, so that words alone decide."""
    monkeypatch.setattr(runs, "MULTIPLIER", multiplier)
    rnd = random.Random(multiplier)
    for _ in range(250):
        n, k = rnd.randint(0, 60), rnd.choice([1, 2, 2, 3, 5])
        words = [rnd.randrange(k) for _ in range(n)]
        if n and rnd.random() < 0.6:
            a, p = rnd.randrange(n), 1 + rnd.randrange(n) // 5
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        exponent, least = rnd.choice([2, 3, 4]), rnd.choice([2, 6])
        catchers, i = runs.SquareCatchers(n, None, exponent, least), 0
        while i < n:
            m = rnd.randint(1, 20)
            catchers.append(np.array(words[i : i + m]))
            i += m
        assert [tuple(r) for r in catchers.runs().tolist()] == brute_runs(words, exponent, least)
        assert brute_runs(words) == fast_runs(words) if n else True


@pytest.mark.parametrize("stream", [1 << 20, 16])
def test_documents_equal_brute_force(spark, docs, awkward, monkeypatch, stream):
    """Also with streams of a few documents and words appended a few at a time."""
    monkeypatch.setattr(runs, "STREAM_WORDS", stream)
    monkeypatch.setattr(runs, "APPENDED_WORDS", stream)
    planted = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0]
    more = [(i, prose(5 + i % 60, i)) for i in planted[:40]] + [(1001, "a b " * 9 + "b b b b b b"), (1002, "x " * 5), (1002, "x " * 6)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    rows = runs.collapse_runs(table.withColumn("n_runs", table.doc_id), planted=True).collect()
    want = Counter(brute_row(i, t) for i, t in awkward + more)
    assert Counter(tuple(r) for r in rows) == want
    assert sum(r["n_runs"] for r in rows) > 10


def test_without_planting_only_real_runs(docs, awkward):
    rows = runs.collapse_runs(docs).collect()
    assert {r["doc_id"]: (r["start"], r["length"], r["period"]) for r in rows if r["n_runs"]} == {16: (0, 5000, 1)}
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in awkward)


def test_empty_table(no_docs):
    assert runs.collapse_runs(no_docs).collect() == []
