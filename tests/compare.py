"""Side-by-side run of registered queries and their DuckDB statements.

    python tests/compare.py [--sf 0.01] [--only prefix,prefix] [--explain]
"""
from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def plain(value):
    """One spelling per value, so that both engines can be compared."""
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (float, decimal.Decimal)):
        f = float(value)
        return "nan" if math.isnan(f) else repr(f + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck_connection(folder):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name, queries, oracles):
    started = time.time()
    df = queries[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    if name not in oracles:
        return ("rows-only", f"{len(rows)} rows", spent)
    rel = con.sql(oracles[name])
    d0 = time.time()
    other = canonical(rel.columns, rel.fetchall())
    mine = canonical(df.columns, rows)
    if mine[0] != other[0]:
        return ("FAIL", f"columns {mine[0]} vs {other[0]}", spent)
    if mine[1] == other[1]:
        return ("ok", f"{len(rows)} rows, duck {time.time() - d0:.1f}s", spent)
    a, b = set(mine[1]), set(other[1])
    return ("FAIL", f"{mine[0]} rows {len(mine[1])} vs {len(other[1])}; only spark {sorted(a - b)[:3]} only duck {sorted(b - a)[:3]} ({len(a - b)} differ)", spent)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--explain", action="store_true")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from haulstat.session import build_session
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{args.sf}"
    con = duck_connection(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [w for w in args.only.split(",") if w]
    bad = 0
    for name in sorted(queries):
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            if args.explain:
                queries[name](spark, folder).explain("formatted")
            state, note, spent = compare(spark, con, folder, name, queries, oracles)
        except Exception as error:
            state, note, spent = "ERROR", str(error)[:900] if "-v" not in sys.argv else traceback.format_exc(), 0.0
        bad += state in ("FAIL", "ERROR")
        print(f"{state:9} {name:38} {spent:6.2f}s  {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
