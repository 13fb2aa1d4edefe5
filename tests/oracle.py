"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\x00"
    if isinstance(v, float):
        return repr(v)
    return str(v)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """(ok, message) after comparing names, row count and values as multisets."""
    got_cols, got = spark_df.columns, [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = canonical(got, got_cols), canonical(want, want_cols)
    if len(a) != len(b):
        return False, f"{len(a)} rows, expected {len(b)}; first differing {next((x for x in zip(a, b) if x[0] != x[1]), None)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ, e.g. {bad[:3]}"
    return True, f"{len(a)} rows"


def main(folder: str, wanted: list[str]) -> int:
    from gridcast.session import build_session
    from gridcast.plans import catalog  # noqa: F401
    from gridcast.plans.registry import REGISTRY, runner

    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    names = [n for n in REGISTRY if not wanted or any(n.startswith(w) for w in wanted)]
    failed = 0
    for name in names:
        entry = REGISTRY[name]
        start = time.time()
        try:
            df = runner(name)(spark, folder)
            if entry.sql is None:
                ok, message = True, f"{df.count()} rows (no SQL)"
            else:
                ok, message = compare(df, con, entry.sql)
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
