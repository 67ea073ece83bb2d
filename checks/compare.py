"""Run queries against their SQL in DuckDB and report differences.

    python -m checks.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import time

import duckdb

from checks.catalog import CHECKS


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns, rows):
    def norm(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, check, sf_dir):
    started = time.time()
    df = check.frame(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    sql = check.oracle()
    if sql is None:
        return len(got), None, spent
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(names)}", spent
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}", spent
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return len(got), f"{len(bad)} rows differ\n   spark {bad[0][0]}\n   duck  {bad[0][1]}", spent
    return len(got), "", spent


def main():
    from isohyet.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session()
    con = duck(args.sf)
    failed = []
    for check in CHECKS:
        if args.names and not any(n == check.name or (n.endswith("*") and check.name.startswith(n[:-1])) for n in args.names):
            continue
        try:
            n, problem, spent = compare(spark, con, check, args.sf)
        except Exception as e:  # noqa: BLE001
            n, problem, spent = -1, f"{type(e).__name__}: {str(e)[:1500]}", 0.0
        state = "ROWS" if problem is None else "FAIL" if problem else "ok"
        print(f"{state:5} {check.name:32} {n:7} rows {spent:6.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(check.name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
