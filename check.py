"""Runs registered queries on Spark and their SQL on DuckDB and compares them.

    python check.py [--sf 0.01] [key-prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    import decimal

    if v is None or v != v:
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_canon(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, key, fn, sql, sf_dir):
    """Problem text, or '' if rows, names and types agree exactly."""
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return "" if got else "no rows", len(got)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(got)
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    if spark_types != duck_types:
        return f"types { {k: (v, duck_types[k]) for k, v in spark_types.items() if v != duck_types[k]} }", len(got)
    a, b = canonical(got, df.columns), canonical(want, names)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}", len(got)
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return f"{sorted(names)}\n    spark {x}\n    duck  {y}", len(got)
    return "" if got else "no rows", len(got)


def main():
    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from tractum.catalog import load
    from tractum.session import get_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--module")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = get_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = load()
    bad = 0
    for key, fn in queries.items():
        if args.keys and not any(key.startswith(k) for k in args.keys):
            continue
        t0 = time.time()
        try:
            problem, n = compare(spark, con, key, fn, oracles.get(key), sf_dir)
        except Exception as e:  # report and go on
            problem, n = "".join(traceback.format_exception_only(e))[:900], -1
        bad += bool(problem)
        kind = "sql " if key in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {key:32s} {n:8d} {time.time() - t0:6.2f}s {problem}", flush=True)
    print("failures:", bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
