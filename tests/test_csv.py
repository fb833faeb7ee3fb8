"""CSV feeds against a line-by-line reader, and one test per rule."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from feedloom.sources.csvfeed import CsvOptions, csv_records, fill_headers, parse_header
from feedloom.sources.lines import scan_payloads

HEADERS = [
    "IP地址,端口,TLS,下载速度(KB/s),城市,数据中心",
    "ip,port,tls,speed (mb/s),city,idc",
    "IP,Port,TLS,Download Speed,City,Country",
    "ip address, port ,speed,tls,country,speed kb,city",
    "ip,myport,speed",
    "ip, 端口",
]


def find(cells, test, last=False):
    hits = [i for i, c in enumerate(cells) if test(c)]
    return (hits[-1] if last else hits[0]) if hits else None


def unit_in(cell):
    return "KB" if "kb" in cell.lower() else "MB" if "mb" in cell.lower() else None


class Header:
    def __init__(self, line):
        cells = [c.strip() for c in line.lower().split(",")]
        has = lambda *words: lambda c: any(w in c for w in words)
        self.size = len(cells)
        self.ip = find(cells, lambda c: c.startswith("ip") or "地址" in c)
        self.port = find(cells, lambda c: c.startswith(("端口", "port")))
        self.tls = find(cells, lambda c: c == "tls")
        self.speed = find(cells, has("速度", "speed"), last=True)
        self.city = find(cells, has("城市", "city"))
        self.country = find(cells, has("国家", "country"))
        self.idc = find(cells, has("数据中心", "idc"), last=True)
        self.unit = None if self.speed is None else unit_in(cells[self.speed])


def read(lines, options):
    """The rows that a reader keeping the current header and unit would return."""
    header, unit, out = None, None, []
    for line in (raw.strip() for raw in lines):
        low = line.lower()
        if ("地址" in line or low.startswith("ip")) and ("端口" in line or "port" in low):
            header = Header(line)
            unit = header.unit
            continue
        row = [c.strip() for c in line.split(",")]
        if not line or header is None or len(row) != header.size:
            continue
        at = lambda i: "" if i is None else row[i]
        if options.only_tls and at(header.tls).lower() != "true":
            continue
        number = re.match(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", at(header.speed), re.I)
        if options.limit > 0 and number:
            unit = unit or unit_in(at(header.speed))
            speed = float(number[0])
            if unit == "KB":
                speed = math.floor(speed / 10 + 0.5) / 100
            if speed < options.limit:
                continue
        port = at(header.port) or ("443" if at(header.tls).lower() == "true" else "80")
        tag = "-".join(filter(None, [at(header.city), at(header.country), at(header.idc)]))
        out.append((at(header.ip), port, tag or at(header.ip)))
        if options.cap and len(out) == options.cap:
            break
    return out


def random_file(draw):
    lines = []
    for _ in range(draw.randrange(1, 40)):
        if draw.random() < 0.2:
            lines.append(draw.choice(HEADERS))
        elif draw.random() < 0.1:
            lines.append(draw.choice(["", " ", "junk", "a,b", "# c,,,,,"]))
        else:
            size = draw.choice([6, 6, 6, 3, 7, 2])
            cell = ["192.0.2.%d" % draw.randrange(255), draw.choice(["", "8443", " 80 "])]
            cell += [
                draw.choice(["true", "TRUE", "false", "", "7", "6000", "5 MB/s", "4.99mb", "5000 KB/s", "x", "kb", "5"])
                for _ in range(size - 2)
            ]
            lines.append(",".join(cell) + draw.choice(["", "\r"]))
    return lines


FILES = {i: random_file(random.Random(i)) for i in range(60)}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(s, n, line) for s, file in FILES.items() for n, line in enumerate(file)]
    return spark.createDataFrame(rows, "source bigint, line_no bigint, line string").repartition(6).cache()


@pytest.mark.parametrize("block_bits", [20, 3])
@pytest.mark.parametrize(
    "options",
    [CsvOptions(), CsvOptions(False, 5, 0), CsvOptions(True, 0, 3), CsvOptions(False, 4.99, 1), CsvOptions(False, 0, 0)],
    ids=str,
)
def test_against_a_reader(lines, options, block_bits):
    got = csv_records(lines, options, block_bits=block_bits).orderBy("source", "line_no").collect()
    ours = {s: [] for s in FILES}
    for r in got:
        ours[r["source"]].append((r["host"], r["port"], r["tag"]))
    want = {s: read(file, options) for s, file in FILES.items()}
    assert ours == want
    assert sum(map(len, want.values())) > 20


def one_file(spark, *lines):
    rows = [("f", n, line) for n, line in enumerate(lines)]
    return spark.createDataFrame(rows, "source string, line_no bigint, line string")


def rows_of(df):
    return [(r["host"], r["port"], r["tag"]) for r in df.orderBy("line_no").collect()]


def test_header_roles(evaluate):
    got = evaluate(lambda c: parse_header(c, F.lit(7)), [HEADERS[3], HEADERS[4]])
    assert tuple(got[0]) == (7, 0, 1, 3, 5, 6, 4, None, "KB", 7)
    assert tuple(got[1]) == (3, 0, None, None, 2, None, None, None, None, 7)


def test_unit_holds_from_the_row_that_names_it_until_the_next_header(spark):
    feed = one_file(
        spark, "ip,port,speed", "192.0.2.1,1,400", "192.0.2.2,2,6000 KB/s", "192.0.2.3,3,400",
        "192.0.2.4,4,none", "ip,port,speed", "192.0.2.5,5,400",
    )
    got = rows_of(csv_records(feed, CsvOptions(False, 5, 0)))
    assert [r[1] for r in got] == ["1", "2", "4", "5"]


def test_limit_is_inclusive(spark):
    feed = one_file(spark, "ip,port,speed", "192.0.2.1,1,5", "192.0.2.2,2,4.99", "192.0.2.3,3,5.01")
    assert [r[1] for r in rows_of(csv_records(feed, CsvOptions(False, 5, 0)))] == ["1", "3"]


def test_rejects_name_the_reason(spark):
    feed = one_file(
        spark, "junk", "ip,port,tls,speed", "192.0.2.1,1,true,9", "192.0.2.2,2,true", "192.0.2.3,3,no,9",
        "192.0.2.4,4,True,1",
    )
    got = csv_records(feed, keep_rejects=True).orderBy("line_no").collect()
    assert [r["reason"] for r in got] == ["no header", None, "cell count", "not tls", "slow"]


def test_empty_input(spark):
    assert csv_records(one_file(spark, " ", "\r")).collect() == []


def test_setting_text():
    assert CsvOptions.from_setting(None) == CsvOptions(True, 5.0, 8)
    assert CsvOptions.from_setting("7") == CsvOptions(True, 7.0, 8)
    assert CsvOptions.from_setting("5:3") == CsvOptions(True, 5.0, 3)
    assert CsvOptions.from_setting("5:") == CsvOptions(True, 5.0, 0)
    assert CsvOptions.from_setting(":8", only_tls=False) == CsvOptions(False, 0.0, 8)
    with pytest.raises(ValueError):
        CsvOptions.from_setting("5:x")
    with pytest.raises(ValueError):
        CsvOptions.from_setting("5:1.5")


def test_one_hot_file_is_filled_across_blocks(spark):
    n = 3000
    feed = spark.range(n).select(
        F.lit("hot").alias("source"),
        F.col("id").alias("line_no"),
        F.when(F.col("id") == 1500, "ip,port,city").when(F.col("id") == 10, "ip,port").otherwise(
            F.concat(F.lit("192.0.2.1,"), F.col("id"), F.when(F.col("id") > 1500, ",c").otherwise(""))
        ).alias("line"),
    )
    filled = fill_headers(feed, block_bits=5)
    got = {r["at"]: r["count"] for r in filled.groupBy(F.col("header.at").alias("at")).count().collect()}
    assert got == {None: 10, 10: 1489, 1500: 1499}
    assert csv_records(feed, CsvOptions(False, 5, 0), block_bits=5).count() == 1489 + 1499


def test_payload_bodies_are_decoded_before_they_are_split(spark):
    body = "a://one\nb://two\r\n\nc://three"
    df = spark.createDataFrame([(1, body)], "source int, body string").withColumn(
        "body", F.base64(F.col("body").cast("binary"))
    )
    got = scan_payloads(df, "body", [("two", "2")]).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in got] == [(0, "a://one"), (1, "b://2\r"), (3, "c://three")]


def test_chain_shares_one_exchange_and_one_sort(spark):
    df = csv_records(one_file(spark, "ip,port,speed", "192.0.2.1,1,9"), CsvOptions(True, 5, 8))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
