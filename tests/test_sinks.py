"""Payloads in parts, and ordered files."""

import base64
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedloom.sinks.files import write_lines
from feedloom.sinks.payloads import base64_parts, payload_parts
from feedloom.streaming.landing import append_to, landing_endpoints


def groups(seed):
    draw = random.Random(seed)
    line = lambda: draw.choice(["", "é", "ab", "漢字x", "long " * 9])
    big = [line() for _ in range(101)]
    return {"big": big, "one": [line()], "two": ["", ""], "five": [line() for _ in range(5)], None: big[::-1]}


@pytest.mark.parametrize("part_bytes, block_bits", [(1 << 26, 20), (100, 20), (50, 2), (7, 3), (1, 4)])
def test_parts_put_together_are_the_payload(spark, part_bytes, block_bits):
    data = groups(part_bytes)
    rows = [(g, i * 7, line) for g, lines in data.items() for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "g string, seq bigint, line string").repartition(5)
    parts = payload_parts(df, ["g"], "seq", "line", part_bytes, block_bits).cache()
    encoded = base64_parts(parts, ["g"], block_bits).collect()
    texts = parts.collect()
    for g, lines in data.items():
        mine = sorted((r["part"], r["text"]) for r in texts if r["g"] == g)
        at = [sum(len(x.encode()) + 1 for x in lines[:i]) // part_bytes for i in range(len(lines))]
        assert [p for p, _ in mine] == sorted(set(at))
        whole = "\n".join(lines)
        assert "\n".join(t for _, t in mine) == whole
        code = "".join(t for _, t in sorted((r["part"], r["text"]) for r in encoded if r["g"] == g))
        assert code == base64.b64encode(whole.encode()).decode()


def test_files_in_name_order_are_the_payload(spark, tmp_path):
    df = spark.range(5000).select(
        F.col("id").alias("seq"), F.concat(F.lit("line "), F.col("id")).alias("line"),
        F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("g"),
    ).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_lines(df, str(tmp_path / "all"), "seq", "line")
        write_lines(df, str(tmp_path / "by"), "seq", "line", by=["g"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = lambda p: "".join(f.read_text() for f in sorted(Path(p).glob("part-*")))
    assert len(list((tmp_path / "all").glob("part-*"))) > 1
    assert read(tmp_path / "all") == "".join(f"line {i}\n" for i in range(5000))
    assert read(tmp_path / "by" / "g=b") == "".join(f"line {i}\n" for i in range(0, 5000, 5))


def test_landing_stream_parses_each_file_once(spark, tmp_path):
    landed, out, state = tmp_path / "landed", str(tmp_path / "out"), str(tmp_path / "state")
    landed.mkdir()

    def run():
        append_to(landing_endpoints(spark, str(landed)), out, state).awaitTermination()
        rows = spark.read.parquet(out).collect()
        return sorted((r["line_no"], str(r["host"]), str(r["reason"])) for r in rows)

    (landed / "one.txt").write_text("a.example:1\n# c\nbad\n")
    first = [(0, "a.example", "None"), (2, "None", "no endpoint")]
    assert run() == first
    (landed / "two.txt").write_text("b.example\n")
    assert run() == sorted([*first, (0, "b.example", "None")])
