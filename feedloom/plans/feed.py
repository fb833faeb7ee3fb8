"""From landed sources to the ranked table of links."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.uri import build_uri
from feedloom.operators.rank import accepted_records, numbered_link, survivors
from feedloom.operators.running import BLOCK_BITS
from feedloom.operators.union import union_sources
from feedloom.sources.csvfeed import CsvOptions, csv_records
from feedloom.sources.records import endpoint_records, good, link_records


def collect_records(
    text_lines: DataFrame | None = None,
    csv_lines: DataFrame | None = None,
    link_lines: DataFrame | None = None,
    csv_options: CsvOptions = CsvOptions(),
    source_bits: int | None = None,
) -> DataFrame:
    """Parse the sources and put them in order.

    Every input has ``source_ord, line_no, line``; a source that is null is left out.
    """
    text = None if text_lines is None else good(endpoint_records(text_lines))
    links = None if link_lines is None else good(link_records(link_lines))
    csv = None
    if csv_lines is not None:
        named = csv_lines.withColumnRenamed("source_ord", "source")
        csv = csv_records(named, csv_options).withColumnRenamed("source", "source_ord")
    return union_sources(text, csv, links, source_bits)


def ranked_feed(
    records: DataFrame,
    user: Column | None = None,
    params: Mapping[str, Column] | None = None,
    unit_aware: bool = False,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """The best record per endpoint with its final link, placed by ``first_seq``.

    Records without a link of their own get one assembled from their columns.
    """
    accepted = accepted_records(records, unit_aware=unit_aware, block_bits=block_bits)
    built = build_uri(
        F.col("scheme"), F.col("host"), F.col("port"), user, params, F.col("tag")
    )
    link = numbered_link(F.coalesce("link", built), F.col("tag_no"))
    return survivors(accepted).withColumn("link", link).drop("source_rank")
