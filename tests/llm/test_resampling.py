import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from checks.compare import connect
from pyspark.sql import functions as F

from feedloom.llm import resampling
from feedloom.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_DIR

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return words, [zlib.crc32(g.encode()) % 10000 for g in grams], grams


def brute(docs, target, percent=5, least=20):
    source, wanted = Counter(), Counter()
    for _, t in docs:
        source.update(features(t)[1])
    for t in target:
        wanted.update(features(t)[1])
    S, T = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (S + 10000) / ((source[b] + 1) * (T + 10000)))) for b in range(10000)}
    rows = []
    for i, t in docs:
        words, found, _ = features(t)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    for rank, r in enumerate(order[: len(order) * percent // 100], 1):
        drawn[(*r[:4], rank)] += 1
        r[4] = None
    return drawn + Counter((*r[:4], None) for r in rows if r[4] is not None)


TARGET = ["the red fox of a quiet hill", "", None, "RED fox, naïve 日本", "run by an old mill " * 4]


@pytest.mark.parametrize("portion", [1 << 21, 60])
@pytest.mark.parametrize("percent", [5, 50, 100])
def test_equals_brute_force(spark, docs, awkward, monkeypatch, portion, percent):
    monkeypatch.setattr(resampling, "PORTION", portion)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id bigint, text string")
    rows = resampling.resample(docs, target, percent=percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(tuple(r) for r in rows) == brute(awkward, TARGET, percent)


def test_table_shares_slots_by_bytes_alone(monkeypatch, awkward):
    """Also when all keys are one, and when keys of different lengths are."""
    texts = pa.array([t for _, t in awkward if len(t or "") < 800] + ["w" * 70 + " " + "v" * 70, "w" * 70, "ab abc abcdefghi"])
    for keys in (None, lambda self, which, size: np.full(len(which), 7, np.uint64)):
        if keys:
            monkeypatch.setattr(resampling.FeatureTable, "_keys", keys)
        for _, _, text in resampling._portions(texts):
            starts, ends, of = text.occurrences()
            table = resampling.FeatureTable(text, starts, ends, 10000)
            spelled = [text.raw[a:b] for a, b in zip(starts, ends)]
            assert Counter(spelled) == Counter(g.encode() for t in texts.to_pylist() for g in features(t)[2])
            assert len(set(zip(spelled, table.slots.tolist()))) == len(set(spelled)) == len(set(table.slots.tolist()))
            assert [int(b) for b in table.bucket[table.slots]] == [zlib.crc32(w) % 10000 for w in spelled]
            assert [int(c) for c in table.count[table.slots]] == [Counter(spelled)[w] for w in spelled]
            if not keys:
                assert [int(k) for k in table.key[table.slots]] == [xxhash.xxh64_intdigest(w) for w in spelled]


def test_hashes_of_all_lengths():
    data = " ".join("x" * i for i in range(1, 70)) + " " + "é" * 50
    (_, _, text), = resampling._portions(pa.array([data]))
    for size in range(1, 70):
        at = np.arange(0, 200, 7)
        raw = [text.raw[i : i + size] for i in at]
        assert resampling.xxh64(text, at, size).tolist() == [xxhash.xxh64_intdigest(r) for r in raw]
        assert resampling.crc32(text, at, size).tolist() == [zlib.crc32(r) for r in raw]


def test_ties_and_repeated_rows(spark):
    rows = [(i % 3, "a b c d " * 6) for i in range(60)] + [(None, "a b c d " * 6)] * 4
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = resampling.resample(docs, docs.select("text").limit(0), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 33))
    assert Counter((r["doc_id"], r["score"], r["rank"]) for r in got) == Counter((r[0], r[3], r[4]) for r in brute(rows, [], 50).elements())


def test_empty_tables(spark, no_docs, docs):
    assert resampling.resample(no_docs, no_docs).collect() == []
    assert resampling.resample(docs, no_docs).where(F.col("n_features") == 0).where("weight <> 0").count() == 0


def test_query_equals_its_sql(spark):
    duck = connect(SF_DIR)
    got = QUERIES["op11_resampling"](spark, SF_DIR).collect()
    want = duck.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({ORACLES['op11_resampling']})").fetchall()
    assert Counter(tuple(r) for r in got) == Counter(want) and len(want) > 100
