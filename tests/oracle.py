"""Run registered queries on Spark and DuckDB and compare the rows.

    python tests/oracle.py [-d FOLDER] [name ...]
"""

from __future__ import annotations

import argparse
import decimal
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, folder):
    """None when equal, else a short report."""
    df = fn(spark, folder)
    types = dict(df.dtypes)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, map(str, rel.types)))
    want = rows_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    if not want[1]:
        return "no rows on either side"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"{len(bad)}/{len(want[1])} rows differ, e.g. {got[0]} spark {bad[0][0]} duckdb {bad[0][1]}"
    expect = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "INTEGER": "int"}
    off = {c: (types[c], w) for c, w in want_types.items() if expect.get(w, types[c]) != types[c] or w in ("HUGEINT",) or w.startswith("DECIMAL")}
    return f"types differ: {off}" if off else None


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("-m", help="only queries of this plans module")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from tessella.plans.registry import MODULE_OF
    from tessella.session import session

    spark = session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.d)
    queries, oracles = entry.queries(), entry.oracle_sql()
    if args.m:
        args.names = [n for n in queries if MODULE_OF[n].endswith("." + args.m)]
    failed = 0
    for name in args.names or queries:
        start = time.time()
        try:
            report = compare(spark, con, name, queries[name], oracles.get(name), args.d)
        except Exception as e:  # report and go on
            report = f"{type(e).__name__}: {str(e)[:700]}"
        mark = "ok " if report is None else "BAD"
        failed += report is not None
        if report is not None or args.names:
            print(f"{mark} {name} {'(rows only) ' if name not in oracles else ''}{time.time() - start:.1f}s {report or ''}", flush=True)
    print(f"{len(args.names or queries)} queries, {failed} bad")
    spark.stop()


if __name__ == "__main__":
    main()
