"""Compare a Spark result with its SQL counterpart, ignoring row order."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def check(spark, con, fn, sql, sf_dir):
    """None when equal, otherwise a short description of the difference."""
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    types = [(type(a).__name__, type(b).__name__) for g, w in zip(got[:50], want[:50]) for a, b in zip(g, w)
             if a is not None and b is not None and type(a) is not type(b)]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {bad[:2]}"
    if types:
        return f"types differ: {set(types)}"
    return None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    names = [a for a in sys.argv[1:] if not a.startswith("/")]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or qs:
        start = time.time()
        try:
            if name in oracles:
                problem = check(spark, con, qs[name], oracles[name], sf)
            else:
                n = qs[name](spark, sf).count()
                problem = None if n else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:28s} {time.time() - start:6.2f}s {'' if name in oracles else '[rows]'} {problem or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
