"""Base64 bodies, JSON payloads and percent escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import constants as K
from feedloom.functions.text import let

REPLACEMENT = "\ufffd"
# A field name that no payload has.
_CLOSED = "closed by feedloom"
BYTE_ORDER_MARK = "\ufeff"


def _squeeze(text: Column) -> Column:
    """Without white space; the wide set is looked for only where text is not ASCII."""

    def rest(narrow: Column) -> Column:
        wide = F.regexp_replace(narrow, f"[{K.SPACE_CLASS}]+", "")
        return F.when(F.octet_length(narrow) == F.length(narrow), narrow).otherwise(wide)

    return let(F.regexp_replace(text, r"[\t\n\x0B\f\r ]+", ""), rest)


def _raw_base64(body: Column) -> Column:
    """Bytes of a body without white space; null when it is not base64.

    Padding is optional but, where present, must not be too long; no length of 4n + 1
    letters is possible. What is left must be letters of the alphabet, which the decoder
    checks.
    """

    def read(core: Column) -> Column:
        padding, rest = F.length(body) - F.length(core), F.length(core) % 4
        fits = (
            ((rest == 0) & (padding == 0))
            | ((rest == 2) & (padding <= 2))
            | ((rest == 3) & (padding <= 1))
        )
        standard = F.replace(
            F.replace(core, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/")
        )
        return F.when(fits & (core != ""), F.try_to_binary(standard, F.lit("base64")))

    return let(F.rtrim(body, F.lit("=")), read)


def _as_text(raw: Column) -> Column:
    """Bytes as UTF-8, broken sequences replaced, without a byte-order mark."""
    return let(
        F.make_valid_utf8(raw.cast("string")),
        lambda t: F.when(t.startswith(BYTE_ORDER_MARK), F.substring(t, 2, 2**31 - 1)).otherwise(t),
    )


def is_base64(text: Column) -> Column:
    """Does the whole body read as base64, standard or URL-safe, padded or not?

    The sniff ignores white space, so ordinary text made of letters can pass.
    """
    return let(_squeeze(text), lambda b: _raw_base64(b).isNotNull())


def decode_base64(text: Column) -> Column:
    """UTF-8 text of a base64 body; null when it is not one."""
    return let(_squeeze(text), lambda b: _as_text(_raw_base64(b)))


def plain_body(text: Column) -> Column:
    """Decode the body if it reads as base64, else keep it."""
    return F.coalesce(decode_base64(text), text)


def encode_base64(data: Column) -> Column:
    """One line of base64; the built-in breaks it every 76 characters."""
    return F.replace(F.base64(data.cast("binary")), F.lit("\r\n"), F.lit(""))


def percent_decode(text: Column) -> Column:
    """Decoded text; null for a broken escape or bytes that are not UTF-8."""

    def checked(plain: Column) -> Column:
        invented = (
            F.contains(plain, F.lit(REPLACEMENT))
            & ~F.contains(text, F.lit(REPLACEMENT))
            & ~F.contains(F.upper(text), F.lit("%EF%BF%BD"))
        )
        return F.when(~(text.rlike(r"%(?![0-9A-Fa-f]{2})") | invented), plain)

    return let(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), checked)


def json_payload(authority: Column) -> Column:
    """The ``add``, ``port`` and ``ps`` fields of a base64 JSON object, all as text.

    The reader stops where a value ends; with the object set inside another one, text after
    it leaves that one without its last field, and the result is null.
    """
    wrapped = F.concat(F.lit('{"object":'), decode_base64(authority), F.lit(f',"{_CLOSED}":1}}'))
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    read = F.from_json(wrapped, f"object struct<{K.JSON_FIELDS}>, `{_CLOSED}` int", options)
    return let(read, lambda r: F.when(r[_CLOSED] == 1, r["object"]))
