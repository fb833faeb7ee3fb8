"""Labels for request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.constants import BROWSER_AGENT
from feedloom.functions.ids import first_listed, valid_ids
from feedloom.functions.text import non_empty


def clean_path(path: Column) -> Column:
    return F.coalesce(non_empty(F.regexp_replace(path, r"/+\z", "")), F.lit("/"))


def query_value(query: Column, name: str) -> Column:
    """First value of a parameter: null when absent, empty when it has none."""
    pair = F.get(
        F.filter(
            F.split(query, "&"), lambda p: (p == name) | p.startswith(f"{name}=")
        ),
        F.lit(0),
    )
    value = F.replace(F.substring(pair, len(name) + 2, 2**31 - 1), F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(value), value)


def feed_target(query: Column) -> Column:
    """The asked-for output: ``target`` in lower case, else ``sub``, ``raw`` or nothing."""
    return (
        F.when(non_empty(query_value(query, "target")).isNotNull(),
               F.lower(query_value(query, "target")))
        .when(query_value(query, "sub").isNotNull(), "sub")
        .when(query_value(query, "raw").isNotNull(), "raw")
        .otherwise("")
    )


def classify_requests(df: DataFrame, ids: Column, forwards: bool = False) -> DataFrame:
    """Adds ``matched_id``, ``route`` and, for feeds, ``output``.

    Columns read: ``path``, ``query``, ``upgrade`` and ``user_agent``. ``ids`` is the text
    of the id list; one malformed id turns every request into an error.
    """
    listed = valid_ids(ids)
    target = feed_target(F.col("query"))
    from_browser = F.contains(F.lower(F.coalesce("user_agent", F.lit(""))), F.lit(BROWSER_AGENT))
    elsewhere = F.lit("forward" if forwards else "not found")
    labelled = df.withColumn("_path", clean_path(F.col("path"))).withColumn(
        "matched_id", first_listed(F.col("_path"), listed["ids"])
    )
    return labelled.withColumn(
        "route",
        F.when(~listed["valid"], "error")
        .when(F.col("upgrade") == "websocket", "websocket")
        .when(F.col("_path") == "/", F.lit("forward" if forwards else "root"))
        .when(F.col("_path") == F.concat(F.lit("/"), F.col("matched_id")), "feed")
        .otherwise(elsewhere),
    ).withColumn(
        "output",
        F.when(
            F.col("route") == "feed",
            F.when((target == "") & from_browser, "page")
            .when(target == "raw", "raw")
            .otherwise("base64"),
        ),
    ).drop("_path")
