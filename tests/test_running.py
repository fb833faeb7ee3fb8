"""Running folds: plain, in blocks, and in blocks of blocks, against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators.cap import cap_per_source
from feedloom.operators.running import HotKeys, hot_keys, hot_keys_of, running

FOLDS = {
    "n": ("count", None),
    "s": ("sum", F.col),
    "m": ("max", F.col),
    "f": ("first", F.col),
    "l": ("last", F.col),
}


def folds():
    return {name: (kind, make and make("v")) for name, (kind, make) in FOLDS.items()}


def loop(rows, inclusive):
    held, out = {}, {}
    for key, seq, value in sorted(rows, key=lambda r: r[1]):
        state = held.setdefault(key, dict(n=0, s=0, m=None, f=None, l=None))
        before = dict(state)
        state["n"] += 1
        if value is not None:
            state["s"] += value
            state["m"] = value if state["m"] is None else max(value, state["m"])
            state["f"] = value if state["f"] is None else state["f"]
            state["l"] = value
        out[(key, seq)] = dict(state) if inclusive else before
    return out


def feed(seed, dense):
    draw = random.Random(seed)
    seqs = range(400) if dense else draw.sample(range(1 << 40), 400)
    keys = ["hot"] * 5 + ["warm", "b", "c"] + [None] * 3
    return [(draw.choice(keys), s, draw.choice([None, draw.randrange(50)])) for s in seqs]


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("dense, block_bits", [(True, 20), (True, 5), (True, 2), (False, 8)])
def test_running_matches_a_loop(spark, inclusive, dense, block_bits):
    rows = feed(block_bits, dense)
    df = spark.createDataFrame(rows, "k string, seq bigint, v bigint").repartition(5)
    got = running(df, ["k"], "seq", folds(), inclusive=inclusive, block_bits=block_bits)
    assert got.columns == ["k", "seq", "v", *FOLDS]
    want = loop(rows, inclusive)
    ours = {(r["k"], r["seq"]): {n: r[n] for n in FOLDS} for r in got.collect()}
    assert ours == want


def test_hot_key_is_cut_into_blocks(spark):
    """The windows of the plan are partitioned by block; the plain one is not used."""
    df = spark.createDataFrame([("hot", s) for s in range(600)], "k string, seq bigint")
    got = running(df, ["k"], "seq", {"n": ("count", None)}, block_bits=6)
    assert sorted(r["n"] for r in got.collect()) == list(range(600))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition(k#" in line]
    assert windows and "_seq_block#" in windows[0].split("windowspecdefinition(")[1].split(" ASC")[0]


def test_null_and_many_hot_keys_are_cut(spark):
    """Every key over a block is found: the null one, and thousands at once."""
    df = spark.range(60_000).selectExpr("CASE WHEN id % 6 > 0 THEN id % 12000 END AS k", "id AS seq")
    hot = hot_keys(df, ["k"], block_bits=2)
    assert hot.hashes.count() == df.select("k").distinct().count() > 10_000 - 1
    marked = hot.mark(df, "hot")
    assert marked.filter("k IS NULL AND hot").count() == 10_000 and marked.filter("NOT hot").count() == 0
    got = running(df, ["k"], "seq", {"n": ("count", None)}, block_bits=2)
    assert got.filter("k IS NULL").agg(F.max("n"), F.count_distinct("n")).first() == (9_999, 10_000)
    assert got.filter("k = 1").select("n").orderBy("n").collect() == [(i,) for i in range(5)]


def test_hot_keys_are_found_and_bounded(spark):
    df = spark.createDataFrame(
        [("a", i % 2) for i in range(40)] + [("b", i) for i in range(5)], "k string, g bigint"
    )
    only = hot_keys(df, ["k"], block_bits=4)
    flagged = only.mark(df, "hot").filter("hot").select("k").distinct().collect()
    assert [r["k"] for r in flagged] == ["a"]
    by_k, by_both, by_g = hot_keys_of(df, [["k"], ["k", "g"], ["g"]], block_bits=4)
    assert [h.hashes.count() for h in (by_k, by_both, by_g)] == [1, 2, 2]
    assert not hot_keys(df, ["k"])
    assert not HotKeys(("k",))


@pytest.mark.parametrize("cap", [0, 1, 3, 8, 1500, -1])
def test_cap_keeps_the_first_rows(spark, cap):
    draw = random.Random(cap)
    rows = [(draw.choice("aaab"), i) for i in draw.sample(range(10**6), 3000)]
    df = spark.createDataFrame(rows, "k string, seq bigint").repartition(7)
    got = {tuple(r) for r in cap_per_source(df, ["k"], "seq", cap, block_bits=6).collect()}
    want = set()
    for key in "ab":
        ordered = sorted(r for r in rows if r[0] == key)
        want |= set(ordered if cap == 0 else ordered[: max(cap, 0)])
    assert got == want


def test_cap_limits_tasks_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS seq")
    plan = cap_per_source(df, ["k"], "seq", 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
