"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usable as a module (``compare_all``) from the tests, or as a script:

    python tests/oracle_compare.py /root/testdata/sf0.01 [query ...]

Comparison: same row count, same column names, and the same multiset of rows
after normalising values (floats exactly, then also to 9 significant digits
so a near-miss is reported as such).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from shopstream.sources.tables import TABLES, table_path  # noqa: E402


def _norm(v, digits=None):
    if v is None:
        return None
    if hasattr(v, "asDict"):
        v = v.asDict(recursive=True)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        return _norm(v.tolist(), digits)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.{digits}g}") if digits else v
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v) if digits else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _rows(columns, rows, digits=None):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare_one(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    res = {"query": name, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        res["status"] = "no-oracle"
        return res
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    res["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS differ: spark={s_cols} oracle={d_cols}"
        return res
    if len(s_rows) != len(d_rows):
        res["status"] = "ROWCOUNT differs"
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a == b:
        res["status"] = "match"
        return res
    a9, b9 = _rows(s_cols, s_rows, 9), _rows(d_cols, d_rows, 9)
    if a9 == b9:
        res["status"] = "near-match (9 digits)"
        return res
    diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
    res["status"] = f"VALUES differ, first: {diffs}"
    return res


def compare_all(spark, sf_dir, names=None):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    out = []
    for name in (names or sorted(qs)):
        try:
            out.append(compare_one(spark, con, name, qs[name], sqls.get(name), sf_dir))
        except Exception as exc:  # report and go on
            out.append({"query": name, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"})
    return out


if __name__ == "__main__":
    from shopstream.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    for r in compare_all(spark, sf, names):
        print(r)
