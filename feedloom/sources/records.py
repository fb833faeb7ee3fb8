"""Endpoint lines and link lines to records, with the reason of each refusal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import constants as K
from feedloom.functions.endpoint import endpoint_parts, link_parts, split_authority
from feedloom.functions.payload import json_payload, percent_decode
from feedloom.functions.text import bind, non_empty, trim

RECORD = ("scheme", "host", "port", "tag", "link")


def _finish(
    df: DataFrame, kept: Sequence[str], record: Sequence[Column], reason: Column
) -> DataFrame:
    named = [c.alias(name) for c, name in zip(record, RECORD)]
    return df.select(*kept, *named, reason.alias("reason"))


def endpoint_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Records of endpoint lines; lines without an endpoint carry a reason."""
    parts = bind(lines, _parts=endpoint_parts(F.col(line)))
    host, port, tag = (F.get("_parts", F.lit(i)) for i in range(3))
    record = [
        F.lit(K.PLAIN_SCHEME),
        host,
        F.coalesce(port, F.lit(K.TLS_PORT)),
        F.coalesce(tag, host),
        F.lit(None).cast("string"),
    ]
    return _finish(parts, lines.columns, record, F.when(host.isNull(), "no endpoint"))


def link_records(
    lines: DataFrame,
    line: str = "line",
    skipped: Sequence[str] = K.SKIPPED_SCHEMES,
    json_schemes: Sequence[str] = K.JSON_SCHEMES,
) -> DataFrame:
    """Records of ``scheme://[user@]authority…[#tag]`` lines; the line itself is the link.

    The authority of a JSON scheme is base64 of an object. A link without a port has a
    null port.
    """
    parts = bind(lines, _parts=link_parts(trim(F.col(line))))
    scheme, authority, escaped = (F.get("_parts", F.lit(i)) for i in range(3))
    is_json = F.coalesce(scheme.isin(list(json_schemes)), F.lit(False))
    read = bind(
        parts,
        _object=F.when(is_json, json_payload(authority)),
        _place=F.when(~is_json, split_authority(authority)),
        _decoded=F.when(~is_json, percent_decode(escaped)),
    )
    obj, place = F.col("_object"), F.col("_place")
    host = F.when(is_json, obj["add"]).otherwise(place["host"])
    # An empty object tag falls back to the host, as a missing one does.
    tag = (
        F.when(is_json, F.coalesce(non_empty(obj["ps"]), obj["add"]))
        .when(escaped.isNull(), place["host"])
        .otherwise(F.col("_decoded"))
    )
    port = F.when(is_json, obj["port"]).otherwise(place["port"])
    reason = (
        F.when(scheme.isNull(), "no link")
        .when(scheme.isin(list(skipped)), "skipped scheme")
        .when(is_json & obj["add"].isNull(), "bad payload")
        .when(tag.isNull(), "bad escape")
    )
    return _finish(read, lines.columns, [scheme, host, port, tag, F.col(line)], reason)


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull())


def reject_counts(parsed: DataFrame, source: str = "source") -> DataFrame:
    """How many lines of each source were refused, and why."""
    return rejects(parsed).groupBy(source, "reason").agg(F.count(F.lit(1)).alias("n"))
