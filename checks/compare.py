"""Run queries and their SQL side by side and report differences.

    python -m checks.compare [folder] [query ...]
"""
from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from tallyscope.session import local_session


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        table = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    bad = 0
    for name in names:
        start = time.time()
        df = QUERIES[name](spark, folder)
        got = [tuple(r) for r in df.collect()]
        took = time.time() - start
        if name not in ORACLE:
            print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        try:
            result = con.execute(ORACLE[name])
        except duckdb.Error as problem:
            bad += 1
            print(f"SQL   {name}: {problem}", flush=True)
            continue
        columns = [d[0] for d in result.description]
        want = result.fetchall()
        same_columns = sorted(columns) == sorted(df.columns)
        left, right = _rows(df.columns, got), _rows(columns, want)
        if same_columns and left == right:
            print(f"same  {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        bad += 1
        print(f"DIFF  {name}: spark {len(got)} rows {sorted(df.columns)}, sql {len(want)} rows {sorted(columns)}")
        only_left = [r for r in left if r not in set(right)][:3]
        only_right = [r for r in right if r not in set(left)][:3]
        print("   spark only", only_left, "\n   sql only  ", only_right, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
