"""Run queries next to their SQL: ``python -m checks.compare SF_DIR [name...]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: repr(float(v)) if isinstance(v, float) else repr(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


def difference(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """What differs between the query and its SQL, or None."""
    df = QUERIES[name](spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if ours != theirs:
        missing = sorted(set(theirs) - set(ours))[:3]
        extra = sorted(set(ours) - set(theirs))[:3]
        return f"rows {len(ours)} / {len(theirs)}; extra {extra}; missing {missing}"
    if not ours:
        return "no rows"
    return None


def main(sf_dir: str, *names: str) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            wrong = difference(spark, con, sf_dir, name) if name in ORACLES else "no SQL"
        except Exception as error:  # a report of all queries is wanted
            wrong = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += wrong is not None
        print(f"{'ok  ' if wrong is None else 'DIFF'} {name:24} {time.time() - start:6.2f}s {wrong or ''}")
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
