"""Matching against lists, by brute force."""

import random

import pytest

from feedloom.operators import match

WORDS = ["alpha", "beta", "gamma", "delta", "é漢字", "😀x", "epsilon-zeta", "a"]


def texts_and_entries(seed):
    draw = random.Random(seed)
    text = lambda n: draw.choice([" ", "  ", "\n"]).join(draw.choices(WORDS, k=n))
    texts = [(i, text(draw.randrange(60))) for i in range(120)] + [(200, ""), (201, None)]
    entries = []
    for place in range(90):
        source = draw.choice(texts[:120])[1] + " filler words that are not there"
        start = draw.randrange(len(source))
        entry = source[start : start + draw.choice([1, 2, 5, 17, 30, 60, 90])]
        entries.append((place, entry))
    entries += [(90, ""), (91, "nowhere to be found at all"), (92, entries[0][1]), (93, None)]
    draw.shuffle(entries)
    return texts, entries


def brute_force(texts, entries):
    found = {}
    for key, text in texts:
        places = [p for p, e in entries if e and text and e in text]
        if places:
            found[key] = min(places)
    return found


@pytest.mark.parametrize("inline_entries", [1000, 0])
@pytest.mark.parametrize("seed", range(3))
def test_first_contained(spark, seed, inline_entries):
    texts, entries = texts_and_entries(seed)
    long_only = [(p, e) for p, e in entries if e is None or len(e) >= 17] if seed == 2 else entries
    got = match.first_contained(
        spark.createDataFrame(texts, "id int, text string").repartition(3),
        "text",
        "id",
        spark.createDataFrame(long_only, "place int, entry string"),
        "entry",
        "place",
        inline_entries=inline_entries,
    )
    assert got.columns == ["id", "text", "place"]
    rows = got.collect()
    ours = {r["id"]: r["place"] for r in rows}
    assert len(ours) == len(rows) and ours == brute_force(texts, long_only)


@pytest.mark.parametrize("inline_entries", [256, 0])
def test_null_and_repeated_keys_are_rows_of_their_own(spark, inline_entries):
    texts = spark.createDataFrame([(None, "alpha beta"), (1, "alpha"), (1, "beta"), (1, None)], "id int, text string")
    entries = spark.createDataFrame([(0, "alpha"), (1, "beta")], "place int, entry string")
    got = match.first_contained(texts, "text", "id", entries, "entry", "place", inline_entries=inline_entries)
    assert sorted((str(r["id"]), r["text"], r["place"]) for r in got.collect()) == [
        ("1", "alpha", 0), ("1", "beta", 1), ("None", "alpha beta", 0),
    ]


def test_every_kind_of_run_is_used(spark):
    entries = ["a longer entry with words and more", "b" * 60, "c" * 20, "dddd", "e"]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(entries)], "_place int, _entry string")
    kinds = {r["_entry"]: r["_kind"] for r in match._anchors(df).collect()}
    assert list(map(kinds.get, entries)) == ["word", "48", "16", "4", "1"]


def test_no_entries(spark):
    texts = spark.createDataFrame([(1, "x")], "id int, text string")
    entries = spark.createDataFrame([], "place int, entry string")
    assert match.first_contained(texts, "text", "id", entries, "entry", "place").collect() == []


def test_short_list_needs_no_join_and_long_list_no_cross_join(spark):
    texts, entries = texts_and_entries(0)
    args = (
        spark.createDataFrame(texts, "id int, text string"), "text", "id",
        spark.createDataFrame(entries, "place int, entry string"), "entry", "place",
    )
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(match.first_contained(*args))
    joined = match.first_contained(*args, inline_entries=0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in joined and "Cartesian" not in joined


def test_allow_list(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,), (" a",)], "id string")
    allow = spark.createDataFrame([(" a\t",), ("a",), ("c",), (None,)], "ok string")
    kept = match.allowed(rows, "id", allow, "ok").collect()
    out = match.refused(rows, "id", allow, "ok").collect()
    assert [r["id"] for r in kept] == ["a"]
    assert sorted(str(r["id"]) for r in out) == [" a", "None", "b", "b"]
