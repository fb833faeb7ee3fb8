"""URI assembly with the URL standard's escapes for each component."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that form encoding leaves alone.
_FORM_KEPT = "-_.*"

# Printable ASCII characters that are escaped (URL standard sets).
FRAGMENT_ESCAPED = r'[ "<>`]'
USER_ESCAPED = r'[ "<>`?{}#^/:;=@\[\\\]|]'


def _escape(text: Column, escaped_class: str) -> Column:
    """Percent-encode non-ASCII, control characters and what the class asks for.

    Texts without any of these stay as they are. Others are form-encoded as a whole, and the
    signs that the class leaves alone are then put back.
    """
    kept = [c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and not re.match(escaped_class, c)]
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    # The percent sign comes last: before, it only begins escapes.
    for sign in sorted(kept, key=lambda c: c == "%"):
        if sign not in _FORM_KEPT:
            encoded = F.replace(encoded, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return F.when(text.rlike(r"[^\x21-\x7E]") | text.rlike(escaped_class), encoded).otherwise(text)


def escape_fragment(text: Column) -> Column:
    return _escape(text, FRAGMENT_ESCAPED)


def escape_user(text: Column) -> Column:
    return _escape(text, USER_ESCAPED)


def escape_form(text: Column) -> Column:
    """Form encoding: blank is a plus sign; the built-in follows the same rule."""
    return F.url_encode(text)


def build_uri(
    scheme: Column,
    host: Column,
    port: Column | None = None,
    user: Column | None = None,
    params: Mapping[str, Column] | None = None,
    fragment: Column | None = None,
) -> Column:
    """``scheme://user@host:port?name=value#fragment``; null parts are left out."""
    none = F.lit("")
    piece = lambda lead, c, tail="": F.coalesce(
        F.concat(F.lit(lead), F.nullif(c, none), F.lit(tail)), none
    )
    query = [
        F.concat(F.lit(f"{name}="), escape_form(value)) for name, value in (params or {}).items()
    ]
    return F.concat(
        scheme,
        F.lit("://"),
        none if user is None else piece("", escape_user(user), "@"),
        host,
        none if port is None else piece(":", port),
        piece("?", F.concat_ws("&", *query)) if query else none,
        none if fragment is None else piece("#", escape_fragment(fragment)),
    )
