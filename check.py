"""Compare registered queries with their SQL on one data folder.

usage: python check.py [-d FOLDER] [name-or-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import time
import traceback

import duckdb

from tracelode.plans import CHECKS, QUERIES
from tracelode.session import local_session
from tracelode.sources.views import BASE_TABLES


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value + 0.0, 6) + 0.0)
    if isinstance(value, int):
        return str(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(normal(r[i])) for i in order) for r in rows)


def kinds(rows, names):
    out = {}
    for i, n in enumerate(names):
        seen = {type(r[i]).__name__ for r in rows if r[i] is not None}
        out[n] = "/".join(sorted(seen))
    return out


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("-d", "--dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("8")
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{args.dir}/{t}.parquet'")
    bad = []
    for name, run in QUERIES.items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        started = time.time()
        try:
            frame = run(spark, args.dir)
            got = [tuple(r) for r in frame.collect()]
            took = time.time() - started
            if name not in CHECKS:
                print(f"rows  {name} {len(got)} rows {took:.1f}s {got[:2] if len(got) else ''}"[:260], flush=True)
                continue
            started = time.time()
            result = con.execute(CHECKS[name])
            columns = [d[0] for d in result.description]
            want = result.fetchall()
            duck = time.time() - started
            problems = []
            if sorted(frame.columns) != sorted(columns):
                problems.append(f"columns {sorted(frame.columns)} vs {sorted(columns)}")
            else:
                a, b = rows_of(frame.columns, got), rows_of(columns, want)
                if len(a) != len(b):
                    problems.append(f"rows {len(a)} vs {len(b)}")
                if a != b:
                    sa, sb = set(a), set(b)
                    problems.append(f"{sorted(frame.columns)} spark-only {sorted(sa - sb)[:3]} sql-only {sorted(sb - sa)[:3]}")
                ka, kb = kinds(got, frame.columns), kinds(want, columns)
                if ka != kb and not problems:
                    problems.append(f"types {ka} vs {kb}")
            if not got:
                problems.append("EMPTY")
            if problems:
                bad.append(name)
                print(f"FAIL  {name} {took:.1f}s/{duck:.1f}s {problems}"[:1200], flush=True)
            else:
                print(f"ok    {name} {len(got)} rows {took:.1f}s/{duck:.1f}s", flush=True)
        except Exception as error:  # noqa: BLE001 - report and go on
            bad.append(name)
            text = str(error).split("JVM stacktrace")[0]
            print(f"ERROR {name} {type(error).__name__}: {text[:900]}", flush=True)
            if "-v" in args.names:
                traceback.print_exc()
    print("bad:", bad)


if __name__ == "__main__":
    main()
