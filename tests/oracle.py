"""Compare queries with their SQL: python -m tests.oracle [sf] [name...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

DATA = "/root/testdata"


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("cardloom-tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v.asDict().values())
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark: SparkSession, name: str, query, sql: str, folder: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, folder)
    ours = rows_of(df.columns, df.collect())
    cur = duck(folder).execute(sql)
    theirs = rows_of([x[0] for x in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] != theirs[1]:
        a, b = set(map(repr, ours[1])), set(map(repr, theirs[1]))
        return f"{len(ours[1])} and {len(theirs[1])} rows; only ours {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return ""


def main(args: list[str]) -> int:
    import __spark_entry__ as e

    folder = f"{DATA}/{args[0] if args else 'sf0.01'}"
    queries, sql, bad = e.queries(), e.oracle_sql(), 0
    spark = session()
    for name in args[1:] or queries:
        t = time.time()
        try:
            if name in sql:
                said = compare(spark, name, queries[name], sql[name], folder)
                n = ""
            else:
                said, n = "", f" rows only: {queries[name](spark, folder).count()}"
        except Exception as x:  # noqa: BLE001
            said, n = f"{type(x).__name__}: {str(x)[:600]}", ""
        bad += bool(said)
        print(f"{name}: {'ok' if not said else 'BAD ' + said}{n} ({time.time() - t:.1f} s)", flush=True)
    print(f"{bad} bad", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
