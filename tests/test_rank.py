"""Best records and tag numbers against a loop over the feed."""

import random
import re

import pytest
from pyspark.sql import functions as F

from feedloom.operators.order import number_rows, packed_seq
from feedloom.operators.rank import accepted_records, keep_best, numbered_link, survivors
from feedloom.operators.union import union_sources
from feedloom.plans.feed import ranked_feed

SCHEMA = "scheme string, host string, port string, tag string, link string, seq bigint"
TAGS = ["x", "y", "5 MB/s", "900 KB/s", "7.5MB/s", "7.5 mb/s z", "1  MB/s", "5 MB/s"]


def speed(tag):
    found = re.search(r"(\d+\.?\d*)(?= ?[MK]B/s)", tag, re.I)
    return float(found[1]) if found else None


def fold(rows):
    """Walk the feed once: every record taken over its key's earlier best gets a number."""
    best, taken, numbers = {}, [], {}
    for scheme, host, port, tag, _, seq in sorted(rows, key=lambda r: r[-1]):
        key, mine = (scheme, host, port), speed(tag)
        if key in best:
            held = best[key]
            if mine is None or (held is not None and mine <= held):
                continue
        best[key] = mine
        numbers[tag] = numbers.get(tag, 0) + 1
        taken.append((key, tag, seq, numbers[tag]))
    return taken


def make_feed(seed, n=150):
    draw = random.Random(seed)
    return [
        ("s", draw.choice("aab"), draw.choice(["1", "1", "2", None]), draw.choice(TAGS), f"l{i}", i * 3)
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("block_bits", [20, 3])
def test_fold(spark, seed, block_bits):
    rows = make_feed(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = fold(rows)
    accepted = accepted_records(df, block_bits=block_bits)
    got = sorted((r["seq"], r["tag"], r["tag_no"]) for r in accepted.collect())
    assert got == sorted((seq, tag, no) for _, tag, seq, no in want)

    first, last = {}, {}
    for key, tag, seq, no in want:
        first.setdefault(key, seq)
        last[key] = (seq, tag, no)
    kept = {
        (r["scheme"], r["host"], r["port"]): (r["first_seq"], (r["seq"], r["tag"], r["tag_no"]))
        for r in survivors(accepted).collect()
    }
    assert kept == {key: (first[key], last[key]) for key in last}

    best = {
        (r["scheme"], r["host"], r["port"]): (r["first_seq"], r["seq"]) for r in keep_best(df).collect()
    }
    assert best == {key: (first[key], last[key][0]) for key in last}


def test_copies_of_a_hot_key_do_not_reach_the_window(spark):
    rows = [("s", "h", "1", "x", "l", i) for i in range(300)] + [("s", "h", "1", "2 MB/s", "m", 300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = accepted_records(df, block_bits=4)
    assert sorted((r["seq"], r["tag_no"]) for r in got.collect()) == [(0, 1), (300, 1)]
    assert "min_by" in got._jdf.queryExecution().optimizedPlan().toString()


def test_result_does_not_depend_on_the_partitions(spark):
    df = spark.createDataFrame(make_feed(11), SCHEMA)
    collect = lambda d: sorted(map(str, ranked_feed(d.withColumn("source_rank", F.lit(0))).collect()))
    assert collect(df.coalesce(1)) == collect(df.repartition(9)) == collect(df.orderBy(F.desc("seq")))


def test_units_count_only_when_asked(spark):
    rows = [("s", "h", "1", "900 KB/s", "a", 1), ("s", "h", "1", "5 MB/s", "b", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert keep_best(df).first()["link"] == "a"
    assert keep_best(df, unit_aware=True).first()["link"] == "b"


def test_links_get_their_number(spark):
    rows = [("s", "h", str(i), "t", None if i else "own", i) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("source_rank", F.lit(0))
    got = ranked_feed(df, user=F.lit("u"), params={"type": F.lit("ws")}).orderBy("first_seq")
    assert [r["link"] for r in got.collect()] == [
        "own", "s://u@h:1?type=ws#t%202", "s://u@h:2?type=ws#t%203",
    ]
    plain = spark.range(1).select(numbered_link(F.lit("l"), F.lit(1)).alias("l")).first()
    assert plain["l"] == "l"


def test_packed_seq_keeps_the_order_and_refuses_what_does_not_fit(spark):
    rows = [(r, s, n) for r in (0, 1, 2, 3) for s in (0, 1, 2**21 - 1) for n in (0, 5, 2**40 - 1)]
    df = spark.createDataFrame(rows, "r int, s bigint, n bigint")
    seq = packed_seq(F.col("r"), F.col("s"), F.col("n")).alias("seq")
    got = [tuple(r)[:3] for r in df.filter("r < 3").select("r", "s", "n", seq).orderBy("seq").collect()]
    assert got == sorted(t for t in rows if t[0] < 3)
    bad = spark.createDataFrame([(0, 2**21, 0)], "r int, s bigint, n bigint").select(seq)
    with pytest.raises(Exception, match="does not fit"):
        bad.collect()


def test_union_gives_large_source_numbers_the_bits_they_need(spark):
    schema = "source_ord bigint, line_no bigint, scheme string, host string, port string, tag string, link string"
    part = spark.createDataFrame([(2**22, 2, "s", "h", "p", "t", None), (5, 9, "s", "h", "p", "t", None)], schema)
    rows = union_sources(text=part, links=part).orderBy("seq").collect()
    assert [r["source_rank"] for r in rows] == [0, 0, 2, 2] and len({r["seq"] for r in rows}) == 4


def test_null_and_empty_key_parts_are_different_keys(spark):
    rows = [(1, "s", "h", "", "t"), (2, "s", "h", None, "t"), (3, "s", "h", None, "t")]
    df = spark.createDataFrame(rows, "seq bigint, scheme string, host string, port string, tag string")
    for bits in (20, 1):
        last = survivors(accepted_records(df, block_bits=bits)).collect()
        assert sorted(r["seq"] for r in last) == sorted(r["seq"] for r in keep_best(df).collect()) == [1, 2]


def test_number_rows_follows_the_order(spark):
    df = spark.createDataFrame([([3, i % 7, -i],) for i in range(200)], "path array<bigint>")
    rows = number_rows(df.repartition(6), "path").orderBy("seq").collect()
    assert [r["path"] for r in rows] == sorted(r["path"] for r in rows)


def test_union_leaves_out_missing_sources(spark):
    part = spark.createDataFrame(
        [(1, 2, "s", "h", "p", "t", None)],
        "source_ord bigint, line_no bigint, scheme string, host string, port string, tag string, link string",
    )
    got = union_sources(csv=part, links=part).orderBy("seq").collect()
    assert [r["source_rank"] for r in got] == [1, 2] and got[0]["seq"] < got[1]["seq"]
    with pytest.raises(ValueError):
        union_sources()
