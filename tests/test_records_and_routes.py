"""Records of links, request labels, settings and whole feeds."""

import base64
import json

from pyspark.sql import functions as F

from feedloom.operators import routes, settings
from feedloom.plans.feed import collect_records, ranked_feed
from feedloom.sources import records

ID = "12345678-1234-4234-9234-123456789012"


def packed(**fields):
    return base64.b64encode(json.dumps(fields).encode()).decode()


def test_link_records(spark):
    lines = [
        "s://u@h.example:1#caf%C3%A9+1",
        " s://h.example\r",
        "s://h:2#",
        "s://h:3#%zz",
        "ssr://h:4",
        "vmess://" + packed(add="j", port=443, ps="p"),
        "vmess://" + packed(add="j", port="80", ps=""),
        "vmess://" + packed(port=1),
        "vmess://%%%",
        "vmess://" + base64.b64encode(b"{'add': 'quoted'}").decode(),
        "nothing",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = records.link_records(df).orderBy("i").collect()
    assert [(r["scheme"], r["host"], r["port"], r["tag"], r["reason"]) for r in got] == [
        ("s", "h.example", "1", "café+1", None),
        ("s", "h.example", None, "h.example", None),
        ("s", "h", "2", "h", None),
        ("s", "h", "3", None, "bad escape"),
        ("ssr", "h", "4", "h", "skipped scheme"),
        ("vmess", "j", "443", "p", None),
        ("vmess", "j", "80", "j", None),
        ("vmess", None, "1", None, "bad payload"),
        ("vmess", None, None, None, "bad payload"),
        ("vmess", None, None, None, "bad payload"),
        (None, None, None, None, "no link"),
    ]
    assert [r["link"] for r in got] == lines
    counts = records.reject_counts(records.link_records(df.withColumn("source", F.lit("x"))))
    assert {r["reason"]: r["n"] for r in counts.collect()} == {
        "bad escape": 1, "skipped scheme": 1, "bad payload": 3, "no link": 1,
    }


def test_parsing_is_not_repeated_by_filters(spark):
    df = spark.createDataFrame([(1, "s://h:1")], "i int, line string")
    plan = records.good(records.link_records(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(trim(") == 1 and plan.count("from_json") == 1


REQUESTS = [
    # path, query, upgrade, user agent -> matched, route, output
    ("/", None, None, None, None, "root", None),
    ("//", None, None, None, None, "root", None),
    ("", None, None, None, None, "root", None),
    (f"/{ID}", None, None, "Mozilla/5.0", ID, "feed", "page"),
    (f"/{ID}/", "", None, "curl", ID, "feed", "base64"),
    (f"/{ID}", "raw", None, "Mozilla", ID, "feed", "raw"),
    (f"/{ID}", "x=1&target=RAW", None, None, ID, "feed", "raw"),
    (f"/{ID}", "target=&sub", None, "MOZILLA", ID, "feed", "base64"),
    (f"/{ID}", "target=clash", None, "mozilla", ID, "feed", "base64"),
    (f"/{ID}", "rawx=1&target", None, "mozilla", ID, "feed", "page"),
    (f"/{ID}/x", None, None, None, ID, "not found", None),
    (f"/a{ID}", None, None, None, ID, "not found", None),
    ("/unknown", None, None, None, None, "not found", None),
    (f"/{ID}", None, "websocket", None, ID, "websocket", None),
    (f"/{ID}", None, "WebSocket", None, ID, "feed", "base64"),
]


def test_classify_requests(spark):
    df = spark.createDataFrame(
        [(i, *r[:4]) for i, r in enumerate(REQUESTS)],
        "i int, path string, query string, upgrade string, user_agent string",
    )
    ids = lambda t: F.lit(t)
    got = routes.classify_requests(df, ids(f" {ID}, ")).orderBy("i").collect()
    assert [(r["matched_id"], r["route"], r["output"]) for r in got] == [r[4:] for r in REQUESTS]
    forwarded = {r["i"]: r["route"] for r in routes.classify_requests(df, ids(ID), forwards=True).collect()}
    assert forwarded[0] == forwarded[10] == "forward" and forwarded[3] == "feed"
    broken = routes.classify_requests(df, ids(f"{ID} nope")).collect()
    assert {r["route"] for r in broken} == {"error"}
    blank = routes.classify_requests(df, ids("")).collect()
    assert {r["matched_id"] for r in blank} == {None}


def test_settings_come_from_one_side(spark):
    df = spark.createDataFrame(
        [(1, "a", None, "x", "y"), (2, None, None, "x", "y"), (3, None, "", "x", None)],
        "i int, ra string, rb string, sa string, sb string",
    )
    got = settings.request_or_stored(df, {"a": ("ra", "sa"), "b": ("rb", "sb")}).orderBy("i").collect()
    assert [(r["a"], r["b"]) for r in got] == [("a", None), ("x", "y"), (None, "")]
    limit = settings.first_setting(F.col("ra"), F.col("sb"), default="5")
    assert [r[0] for r in df.orderBy("i").select(limit).collect()] == ["a", "y", "5"]


def test_whole_feed(spark):
    schema = "source_ord bigint, line_no bigint, line string"
    text = spark.createDataFrame(
        [(0, 0, "a.example:1#t 5 MB/s"), (0, 1, "a.example:1#t 4 MB/s"), (0, 2, "bad"), (1, 0, "b.example")], schema
    )
    csv = spark.createDataFrame(
        [(0, 0, "ip,port,tls,city"), (0, 1, "192.0.2.1,,true,X"), (0, 2, "192.0.2.2,81,no,X")], schema
    )
    links = spark.createDataFrame(
        [(0, 0, "vless://u@a.example:1#t%209%20MB/s"), (0, 1, "s://h:1#X"), (0, 2, "ssr://h:1")], schema
    )
    got = ranked_feed(collect_records(text, csv, links), user=F.lit("me")).orderBy("first_seq").collect()
    assert [(r["host"], r["link"]) for r in got] == [
        ("a.example", "vless://u@a.example:1#t%209%20MB/s"),
        ("b.example", "vless://me@b.example:443#b.example"),
        ("192.0.2.1", "vless://me@192.0.2.1:443#X"),
        ("h", "s://h:1#X%202"),
    ]
    only = ranked_feed(collect_records(link_lines=links)).count()
    assert only == 2
