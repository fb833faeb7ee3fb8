import base64
import gzip
import hashlib
import os
from collections import Counter

import pytest

from feedloom.llm import warc

PAGES = [
    (1, "http://a.example/", "<p>same</p>"),
    (2, "http://a.example/2", "<p>same</p>"),
    (3, None, "<p>other é\r\n\r\nwith blank lines</p>"),
    (4, "http://bad.example/x y\r\nInjected: 1", None),
    (5, "", ""),
    (6, "http://a.example/big", "z" * 300_000),
    (7, "http://a.example/7", "<p>tie</p>"),
    (7, "http://a.example/7", "<p>tie</p>"),
    (8, "http://a.example/8", "<p>own</p>"),
    (None, "http://n.example/", "<p>same</p>"),
    (-4, "http://a.example/-4", "<p>tie</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "file", 1) for p in PAGES]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, file string, length int").repartition(3)


def brute(smallest=0):
    best = {}
    for i, _, html in PAGES:
        if i is not None and len((html or "").encode()) >= smallest:
            best[html or ""] = max(best.get(html or "", i), i)
    out = Counter()
    for i, _, html in PAGES:
        data = (html or "").encode()
        to = best.get(html or "")
        old = i is not None and to is not None and i < to
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out[i, len(data), digest, "revisit" if old else "response", to if old else None] += 1
    return out


@pytest.mark.parametrize("smallest", [0, 12])
@pytest.mark.parametrize("setting", [{}, {"FILE_BYTES": 300, "READ_BYTES": 500, "GAP_BYTES": 0, "TASK_BYTES": 256}])
def test_round_trip(pages, monkeypatch, smallest, setting):
    for name, value in setting.items():
        monkeypatch.setattr(warc, name, value)
    index, folder = warc.archive_pages(pages, smallest)
    rows = warc.read(index, folder).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == brute(smallest)
    want = {i: (h or "").encode() for i, _, h in PAGES}
    assert all(bytes(r["payload"]) == want[r["page_id"]] for r in rows if r["record_type"] == "response")
    assert all(r["payload"] is None for r in rows if r["record_type"] == "revisit")
    urls = {r["page_id"]: r["url"] for r in rows}
    assert urls[3] is None and urls[5] is None and urls[4] == "http://bad.example/x%20y%0D%0AInjected:%201"


def test_archives_are_plain_gzip_members(pages):
    index, folder = warc.archive_pages(pages)
    local = folder.removeprefix("file:")
    for r in index.collect():
        with open(os.path.join(local, r["file"]), "rb") as f:
            f.seek(r["offset"])
            data = gzip.decompress(f.read(r["length"]))
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")


def test_selected_records_only(pages):
    index, folder = warc.archive_pages(pages)
    chosen = index.where("url like '%a.example%' and record_type = 'response'")
    assert sorted(r["page_id"] for r in warc.read(chosen, folder).collect()) == [2, 6, 7, 7, 8]


def test_damage_is_noticed():
    data, _, _ = warc.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    assert warc.parse(data)[1] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload", b"paxload"))


def test_ranges_are_coalesced():
    rows = [{"file": f, "offset": o, "length": 10} for f, o in (("a", 0), ("a", 10), ("a", 30), ("a", 1 << 20), ("b", 0))]
    assert [len(r) for r in warc.ranges(iter(rows))] == [3, 1, 1]


def test_empty_table(pages):
    index, folder = warc.archive_pages(pages.limit(0))
    assert warc.read(index, folder).count() == 0
