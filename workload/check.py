"""Runs every registered query and its SQL on the same files and compares all rows.

    python -m workload.check /root/testdata/sf0.01 [name part ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from .common import TABLES

# Type names of the two engines that hold the same values.
_SAME_TYPE = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def _ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def difference(df, connection, sql: str) -> str | None:
    """What differs between the two results, or None."""
    answer = connection.execute(sql)
    theirs = {d[0]: _SAME_TYPE.get(str(d[1]), str(d[1]).lower()) for d in answer.description}
    ours = dict(df.dtypes)
    if sorted(theirs) != sorted(ours):
        return f"columns {sorted(ours)} instead of {sorted(theirs)}"
    wrong = {c: (t, theirs[c]) for c, t in ours.items() if t != theirs[c]}
    if wrong:
        return f"types {wrong}"
    names = sorted(ours)
    place = [list(theirs).index(c) for c in names]
    expected = _ordered([tuple(r[i] for i in place) for r in answer.fetchall()])
    got = _ordered([tuple(r[c] for c in names) for r in df.collect()])
    if len(got) != len(expected):
        return f"{len(got)} rows instead of {len(expected)}"
    for a, b in zip(got, expected, strict=True):
        if a != b:
            return f"{a} instead of {b} ({names})"
    return None


def main(folder: str, parts: list[str]) -> int:
    from pyspark.sql import SparkSession

    from . import QUERIES

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = oracle(folder), 0
    for name, query in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            df = query.run(spark, folder)
            problem = difference(df, connection, query.sql) if query.sql else None
        except Exception as exc:  # reported, and the next query still runs
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.2f}s", problem or "")
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1].rstrip("/"), sys.argv[2:])))
