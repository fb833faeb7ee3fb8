"""Column functions on edge cases, several against small Python models."""

import base64
import math
import random
import re
import string
import urllib.parse
import uuid

import pytest
from pyspark.sql import functions as F

from feedloom.constants import SPACE
from feedloom.functions import endpoint, ids, measure, payload, pool, text, uri


def test_trim_takes_the_wide_white_space_set(evaluate):
    cases = ["\t a\r", "\ufeffx y\u3000", "\u00a0\u2003z", "", SPACE, "\x85a"]
    assert evaluate(text.trim, cases) == ["a", "x y", "z", "", "", "\x85a"]


def test_split_lines(evaluate):
    body = "\n a \n\n\n#c\n\tb\r\n"
    assert evaluate(text.split_lines, [body]) == [["a", "#c", "b"]]
    assert evaluate(lambda c: text.split_lines(c, ","), ["x,, y\nz,"]) == [["x", "y\nz", ""]]


def test_replace_token_is_literal(evaluate):
    assert evaluate(lambda c: text.replace_token(c, "a.*", "$1"), ["a.*b a.* axx"]) == ["$1b $1 axx"]


ENDPOINTS = {
    "a.example": ("a.example", None, None),
    "a.example:8443": ("a.example", "8443", None),
    "192.0.2.1:80#x y": ("192.0.2.1", "80", "x y"),
    "[2001:db8::1]:443#v6": ("[2001:db8::1]", "443", "v6"),
    "a.example/path#no": ("a.example", None, None),
    "###": None,
    "A.EXAMPLE#Up": ("A.EXAMPLE", None, "Up"),
    "a.b.1": ("a.b", None, None),
    "a..b": None,
    ".a.b": None,
    "a.com..b": ("a.com", None, None),
    "1.2.3.4.5": ("1.2.3.4", None, None),
    "1234.5.6.7": None,
    "localhost:80": None,
    "a.example:#t": ("a.example", None, None),
    "a.example:99#": ("a.example", "99", None),
    "a.example:99#t\rmore": ("a.example", "99", None),
    "x_y.example-.z9:1": ("x_y.example-.z", None, None),
    "[2001:DB8::g]": None,
    "\na.example": None,
    "": None,
    "a." * 20000 + "example:7": ("a." * 20000 + "example", "7", None),
}


def test_endpoint_parts(evaluate):
    got = evaluate(endpoint.endpoint_parts, list(ENDPOINTS))
    assert [None if g is None else tuple(g) for g in got] == list(ENDPOINTS.values())


def test_endpoint_parts_against_the_stated_pattern(evaluate):
    pattern = re.compile(
        r"^((?:[\w-]+\.)+[a-z-]+|\d{1,3}(?:\.\d{1,3}){3}|\[[a-f0-9:]+\])(?::(\d+))?(?:#(.+)\Z)?",
        re.I | re.A,
    )
    draw = random.Random(7)
    lines = ["".join(draw.choices("aab11...._-:#[]/ Z", k=draw.randrange(14))) for _ in range(6000)]
    expected = [m and [g for g in m.groups()] for m in map(pattern.match, lines)]
    assert evaluate(endpoint.endpoint_parts, lines) == expected
    assert sum(e is not None for e in expected) > 100


LINKS = {
    "s://u@h.example:1#t%20x": ("s", "h.example:1", "t%20x"),
    "s://h.example": ("s", "h.example", None),
    "s://h.example:2/p?q=1#": ("s", "h.example:2", None),
    "s://u@v@h:3": ("s", "h:3", None) ,
    "s://[2001:db8::1]:4?x": ("s", "[2001:db8::1]:4", None),
    "s://h:5/a b": None,
    "s:/h": None,
    "no link": None,
    "s://h:6#a#b c": ("s", "h:6", "a#b c"),
    "s://h:7#a\nb": None,
}


def test_link_parts(evaluate):
    got = evaluate(endpoint.link_parts, list(LINKS))
    want = list(LINKS.values())
    # The user part may not hold an at sign, so the authority starts after the first one.
    want[3] = ("s", "v@h:3", None)
    assert [None if g is None else tuple(g) for g in got] == want


def test_split_authority(evaluate):
    cases = ["h:1", "h", "[2001:db8::1]", "[2001:db8::1]:2", "a:b:c", ":5"]
    got = [tuple(r) for r in evaluate(endpoint.split_authority, cases)]
    assert got == [("h", "1"), ("h", None), ("[2001:db8::1]", None), ("[2001:db8::1]", "2"), ("a:b", "c"), ("", "5")]


def test_parse_login(evaluate):
    cases = ["user:pass@host:1080", "host:1080", "x@u:p@h:1", "@h:2", "u@", "h", "u:p@[2001:db8::1]:9"]
    got = [r and tuple(r) for r in evaluate(endpoint.parse_login, cases)]
    assert got == [
        ("user", "pass", "host", 1080),
        (None, None, "host", 1080),
        ("u", "p", "h", 1),
        (None, None, "h", 2),
        None,
        (None, None, "", None),
        ("u", "p", "[2001:db8::1]", 9),
    ]


def test_parse_relay(evaluate):
    cases = ["h:1", "h", "[2001:db8::1]", "[2001:db8::1]:8", "[zz]", "a:b:c"]
    got = [r and tuple(r) for r in evaluate(endpoint.parse_relay, cases)]
    assert got == [("h", "1"), ("h", "443"), ("[2001:db8::1]", "443"), ("[2001:db8::1]", "8"), None, ("a", "b")]


def strict_base64(body):
    """Decode as a forgiving browser would: white space out, padding optional but right."""
    body = re.sub(f"[{re.escape(SPACE)}]+", "", body)
    core = body.rstrip("=")
    padding = len(body) - len(core)
    if not core or not re.fullmatch(r"[A-Za-z0-9+/_-]+", core) or padding > 2:
        return None
    missing = -len(core) % 4
    if missing == 3 or (padding and padding > missing):
        return None
    return base64.b64decode(core.replace("-", "+").replace("_", "/") + "=" * missing)


def test_base64_sniff_and_decode_against_a_model(evaluate):
    draw = random.Random(3)
    cases = ["", " ", "=", "A", "AA", "AA=", "AA==", "AAA=", "AAA==", "AAAA=", "AAAA==", "QUJD\nREVG", "QUJ D"]
    cases += ["".join(draw.choices("AZaz09+/-_= \n\u00a0é", k=draw.randrange(9))) for _ in range(1500)]
    cases += ["".join(draw.choices("AZaz09+/", k=draw.randrange(12))) + "=" * draw.randrange(4) for _ in range(500)]
    want = [strict_base64(c) for c in cases]
    assert evaluate(payload.is_base64, cases) == [w is not None for w in want]
    shown = [None if w is None else w.decode("utf-8", "replace").removeprefix("\ufeff") for w in want]
    ours = evaluate(payload.decode_base64, cases)
    # How many marks replace a broken sequence is left open; the valid text must agree.
    marks = lambda t: t and re.sub("\ufffd+", "\ufffd", t)
    assert [marks(t) for t in ours] == [marks(t) for t in shown]
    kept = evaluate(payload.plain_body, cases)
    assert [k for k, w in zip(kept, want) if w is None] == [c for c, w in zip(cases, want) if w is None]


def test_base64_round_trip_of_long_text(evaluate):
    body = "é漢字 line\n" * 20000
    encoded = base64.b64encode(body.encode()).decode()
    assert evaluate(payload.encode_base64, [body]) == [encoded]
    assert evaluate(payload.plain_body, [encoded, body]) == [body, body]


def test_byte_order_mark_is_dropped_once(evaluate):
    encoded = base64.b64encode("\ufeff\ufeffx".encode()).decode()
    assert evaluate(payload.decode_base64, [encoded]) == ["\ufeffx"]


def test_percent_decode(evaluate):
    cases = ["a%20b", "a+b", "%E4%BD%A0", "%zz", "%2", "%FF", "%EF%BF%BD", "\ufffd", "%%31", ""]
    assert evaluate(payload.percent_decode, cases) == [
        "a b", "a+b", "你", None, None, None, "\ufffd", "\ufffd", None, "",
    ]


def test_leading_number(evaluate):
    cases = ["5.25 MB/s", "7", "-.5x", "1e3kb", "5.", "kb", "", "+2", "Infinity", "1e", "0x10"]
    assert evaluate(measure.leading_number, cases) == [
        5.25, 7.0, -0.5, 1000.0, 5.0, None, None, 2.0, math.inf, 1.0, 0.0,
    ]


def test_units_and_rounding(evaluate):
    assert evaluate(measure.unit_of, ["kB", "Mb/s", "mb kb", "x"]) == ["KB", "MB", "KB", None]
    kilo = lambda c: measure.to_mega(c.cast("double"), F.lit("KB"))
    assert evaluate(kilo, ["1000", "1234", "1235", "4", "5", "-5"]) == [1.0, 1.23, 1.24, 0.0, 0.01, 0.0]


def test_tag_measure(evaluate):
    cases = ["a 5.5 MB/s b 9 MB/s", "900KB/s", "7  MB/s", "8 mb/S", "x", "3. kb/s", "12GB/s"]
    assert evaluate(measure.tag_measure, cases) == [5.5, 900.0, None, 8.0, None, 3.0, None]
    aware = evaluate(lambda c: measure.tag_measure(c, unit_aware=True), cases)
    assert aware == [5.5, 0.9, None, 8.0, None, 0.003, None]


def test_ports_and_tags(evaluate):
    port = lambda tls: lambda c: measure.default_port(c, F.lit(tls).cast("string"))
    assert evaluate(port("TRUE"), ["", None, "8"]) == ["443", "443", "8"]
    assert evaluate(port("no"), ["", None, "8"]) == ["80", "80", "8"]
    assert evaluate(port(None), ["", None]) == ["80", "80"]
    tag = lambda c: measure.compose_tag(F.lit("ip"), c, F.lit(""), F.lit(None).cast("string"))
    assert evaluate(tag, ["city", "", None]) == ["city", "ip", "ip"]


def test_id_lists(evaluate):
    good = "12345678-1234-4234-9234-123456789012"
    cases = ["", None, good, good.upper() + " ,\n" + good, good + ",x", good.replace("-4", "-6", 1),
             good.replace("-4", "-0", 1), good.replace("-9", "-c", 1), " , "]
    got = [(len(r["ids"]), r["valid"]) for r in evaluate(ids.valid_ids, cases)]
    assert got == [(0, True), (0, True), (1, True), (2, True), (2, False), (1, False), (1, False), (1, False), (0, True)]


def test_uuid_text_and_first_listed(evaluate):
    value = uuid.UUID("0a0b0c0d-0102-4304-8506-0708090a0b0c")
    assert evaluate(lambda c: ids.uuid_text(F.unhex(c)), [value.hex]) == [str(value)]
    listed = lambda c: ids.first_listed(c, F.array(*map(F.lit, ["b", "", "a", "ab"])))
    assert evaluate(listed, ["xaby", "xa", "z", ""]) == ["b", "a", None, None]


def test_pool_entries_and_pick(evaluate):
    cases = ["a, b\n#c,,d", "", " #x ", None]
    assert evaluate(pool.pool_entries, cases) == [["a", "b", "d"], [], [], None]
    assert evaluate(lambda c: pool.pool_entries(c, skip_comments=False), ["a #b"]) == [["a", "#b"]]
    one = lambda c: pool.pick(pool.pool_entries(F.lit("p,q,r")), c)
    keys = [str(i) for i in range(300)]
    got = evaluate(one, keys)
    assert got == evaluate(one, keys) and set(got) == {"p", "q", "r"}
    assert min(got.count(e) for e in "pqr") > 60
    assert evaluate(lambda c: pool.pick(pool.pool_entries(c), F.lit("k")), ["", None, "x"]) == [None, None, "x"]


@pytest.mark.parametrize("alphabet", [string.printable.replace("\n", ""), "é漢😀 #%/?"])
def test_uri_parts_decode_back(evaluate, alphabet):
    draw = random.Random(5)
    texts = ["".join(draw.choices(alphabet, k=8)) for _ in range(200)]
    texts = [t for t in texts if "%" not in t]
    shown = evaluate(uri.escape_fragment, texts)
    assert [urllib.parse.unquote(t) for t in shown] == texts
    assert not any(c in t for t in shown for c in ' "<>`')
    rule = lambda t, signs: "".join(
        urllib.parse.quote(c, safe="") if c in signs or not "!" <= c <= "~" else c for c in t
    )
    assert shown == [rule(t, ' "<>`') for t in texts]
    users = evaluate(uri.escape_user, texts)
    assert users == [rule(t, ' "<>`?{}#^/:;=@[\\]|') for t in texts]
    assert [urllib.parse.unquote(t) for t in users] == texts
    assert not any(c in t for t in users for c in "@/:?#[]")


def test_build_uri(evaluate):
    def built(tag):
        return uri.build_uri(
            F.lit("s"), F.lit("h.example"), F.lit("1"), F.lit("u"), {"p": F.lit("/?a b"), "q": F.lit("x&y")}, tag
        )

    assert evaluate(built, ["a b/%c", "", None]) == [
        "s://u@h.example:1?p=%2F%3Fa+b&q=x%26y#a%20b/%c",
        "s://u@h.example:1?p=%2F%3Fa+b&q=x%26y",
        "s://u@h.example:1?p=%2F%3Fa+b&q=x%26y",
    ]
    bare = lambda c: uri.build_uri(F.lit("s"), c, None)
    assert evaluate(bare, ["h"]) == ["s://h"]
