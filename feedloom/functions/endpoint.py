"""Host, port and tag out of endpoint lines and authorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import constants as K
from feedloom.functions.text import groups, non_empty


def endpoint_parts(line: Column) -> Column:
    """Host, port and tag of ``host[:port][#tag]`` as an array; null when there is none.

    The host is anchored at the start of the line only; text after the parts is ignored.
    """
    return groups(line, K.ENDPOINT, 3)


def link_parts(link: Column) -> Column:
    """Scheme, authority and escaped tag of a link as an array; null when it is none."""
    return groups(link, K.LINK, 3)


def split_authority(authority: Column) -> Column:
    """``host:port`` at the last colon; a bare host or bare ``[IPv6]`` has no port."""
    bare = ~F.contains(authority, F.lit(":")) | authority.endswith("]")
    port = F.substring_index(authority, ":", -1)
    host = F.left(authority, F.length(authority) - F.length(port) - 1)
    return F.struct(
        F.when(bare, authority).otherwise(host).alias("host"),
        F.when(~bare, port).alias("port"),
    )


def parse_login(address: Column) -> Column:
    """``user:pass@host:port`` read from the right; null for an empty address."""
    pieces = F.split(address, "@")
    right = F.get(pieces, F.size(pieces) - 1)
    left = non_empty(F.get(pieces, F.size(pieces) - 2))
    port = F.substring_index(right, ":", -1)
    with_colon = F.contains(right, F.lit(":"))
    return F.when(
        right != "",
        F.struct(
            F.get(F.split(left, ":"), F.lit(0)).alias("user"),
            F.get(F.split(left, ":"), F.lit(1)).alias("password"),
            F.when(with_colon, F.left(right, F.length(right) - F.length(port) - 1))
            .otherwise("")
            .alias("host"),
            port.try_cast("int").alias("port"),
        ),
    )


def parse_relay(address: Column) -> Column:
    """``host[:port]`` or ``[IPv6][:port]``; the port falls back to the TLS port."""
    bracketed = F.contains(address, F.lit("["))
    ip6 = non_empty(F.regexp_extract(address, K.BRACKETED, 1))
    port6 = non_empty(F.regexp_extract(address, K.BRACKETED, 2))
    pieces = F.split(address, ":")
    host = F.when(bracketed, ip6).otherwise(F.get(pieces, F.lit(0)))
    port = F.when(bracketed, port6).otherwise(F.get(pieces, F.lit(1)))
    return F.when(
        host.isNotNull(),
        F.struct(host.alias("host"), F.coalesce(port, F.lit(K.TLS_PORT)).alias("port")),
    )
