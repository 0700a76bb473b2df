"""Run registered queries on Spark and their SQL on DuckDB, and compare: ``python tests/check.py [sf] [names...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0null"
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return repr(v + 0.0) if v != int(v) or abs(v) > 1e15 else repr(float(int(v)))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v if isinstance(v, (int, str)) else str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in cols]).collect()
    return cols, dict(df.dtypes), sorted((tuple(norm(v) for v in r) for r in rows), key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    return sorted(names), types, sorted(rows, key=repr)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    cols, stypes, rows = spark_rows(fn(spark, sf_dir))
    t1 = time.time()
    if sql is None:
        return len(rows) > 0, f"rows={len(rows)} (rows only) {t1 - t0:.1f}s"
    dcols, dtypes, drows = duck_rows(con, sql)
    t2 = time.time()
    info = f"rows={len(rows)}/{len(drows)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if cols != dcols:
        return False, f"{info} columns {cols} != {dcols}"
    bad = [(c, stypes[c], dtypes[c]) for c in cols if TYPES.get(stypes[c]) != dtypes[c]]
    if bad:
        return False, f"{info} types {bad}"
    if rows != drows:
        only_s = sorted(set(rows) - set(drows), key=repr)[:2]
        only_d = sorted(set(drows) - set(rows), key=repr)[:2]
        n = sum(a != b for a, b in zip(rows, drows))
        diff = ""
        if only_s and only_d:
            diff = [(c, a, b) for c, a, b in zip(cols, only_s[0], only_d[0]) if a != b][:6]
        return False, f"{info} values differ ({n})\n   spark {only_s}\n   duck  {only_d}\n   {diff}"
    return True, info


def main() -> int:
    from daymark.session import get_spark
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_spark("check", 8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, info = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as exc:  # a failing query must not hide the others
            ok, info = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        print(("ok   " if ok else "FAIL ") + f"{name}: {info}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
