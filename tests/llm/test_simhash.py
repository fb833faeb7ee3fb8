import random
from collections import Counter

import pytest
import xxhash

from feedloom.llm import components, simhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mark(text):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def roots(marks, radius=3):
    label = list(range(len(marks)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(marks):
        for j in range(i):
            if (a ^ marks[j]).bit_count() <= radius:
                a_, b_ = root(i), root(j)
                label[max(a_, b_)] = min(a_, b_)
    return [root(i) for i in range(len(marks))]


def test_equals_brute_force(docs, awkward):
    marks = [mark(t) for _, t in awkward]
    of = roots(marks)
    want = Counter()
    for i, (doc_id, _) in enumerate(awkward):
        ids = [d for (d, _), r in zip(awkward, of) if r == of[i] and d is not None]
        want[doc_id, f"{marks[i]:016x}", min(ids, default=None)] += 1
    got = simhash.near_duplicates(docs)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == want


@pytest.mark.parametrize("own, most", [(1024, 8192), (2, 4)])
@pytest.mark.parametrize("radius", [2, 3])
def test_links_of_clustered_fingerprints(spark, monkeypatch, own, most, radius):
    """Chains and dense clusters, with prefixes dealt once and many times over."""
    monkeypatch.setattr(simhash, "OWN", own)
    monkeypatch.setattr(simhash, "MOST_OWN", most)
    rng = random.Random(5)
    marks = {0, (1 << 64) - 1}
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(12):
            marks.add(base)
            for _ in range(rng.choice([1, 2, 3, 4])):
                base ^= 1 << rng.randrange(64)
    marks = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    distinct = spark.createDataFrame([(m,) for m in signed], "bits bigint")
    edges = simhash.links(distinct, radius).collect()
    assert all((marks[signed.index(e["src"])] ^ marks[signed.index(e["dst"])]).bit_count() <= 64 for e in edges)
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    groups = [found.get(m, m) for m in signed]
    want = roots(marks, radius)
    assert len(set(zip(groups, want))) == len(set(groups)) == len(set(want))


def test_cold_prefixes_beside_a_hot_one(spark, monkeypatch):
    """Prefixes that own one fingerprint, or none, but are reached by very many with bits flipped."""
    monkeypatch.setattr(simhash, "MOST_OWN", 8)
    above = spark.sparkContext.accumulator(0)
    rng = random.Random(11)
    base = rng.getrandbits(64)
    marks = {base ^ sum(1 << b for b in rng.sample(range(40), k)) for k in (1, 3, 5, 7) for _ in range(150)}
    marks |= {base ^ (1 << 62), base ^ (1 << 61) ^ (1 << 3), base ^ (3 << 61) ^ (1 << 50)}
    marks = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    meet = simhash._meet

    def measured(group, *rest):
        depth = int(group["depth"].iloc[0])
        above.add(int(depth <= 56 and len(group) > 8 * (1 + depth + depth * (depth - 1) // 2)))
        return meet(group, *rest)

    monkeypatch.setattr(simhash, "_meet", measured)
    edges = simhash.links(spark.createDataFrame([(m,) for m in signed], "bits bigint")).collect()
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    groups = [found.get(m, m) for m in signed]
    want = roots(marks)
    assert len(set(zip(groups, want))) == len(set(groups)) == len(set(want))
    assert above.value == 0


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 130)]
    edges = [*chain, *star, (5, 5), (7, 8), (8, 7), (None, 3), (200, 199)]
    rows = components.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(got)
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {199: 199, 200: 199}
    assert components.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0
