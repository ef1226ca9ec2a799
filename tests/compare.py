"""Side-by-side check of a Spark query against its DuckDB oracle (row count, column names, and an
order-insensitive hash of the values with floats rounded to 6 places). Used by the tests and by
``python tests/compare.py`` while developing."""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math
import sys

import numpy as np


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None  # pandas turns nulls of float columns into NaN
    if isinstance(v, (np.floating,)):
        v = float(v)
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_, bool)):
        return bool(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def table_digest(columns: list[str], rows: list[tuple]) -> tuple[int, list[str], str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    normed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256("\n".join(normed).encode()).hexdigest()
    return len(rows), cols, h


def spark_rows(df):
    rows = [tuple(r) for r in df.collect()]
    return df.columns, [tuple(_to_py(x) for x in r) for r in rows]


def _to_py(x):
    from pyspark.sql import Row

    if isinstance(x, Row):
        return x.asDict(recursive=True)
    if isinstance(x, list):
        return [_to_py(y) for y in x]
    return x


def duck_connect(sf_dir: str):
    import duckdb

    from tunedata.sources.tables import TABLE_NAMES

    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(spark, con, sf_dir: str, name: str, build, sql: str) -> dict:
    s_cols, s_rows = spark_rows(build(spark, sf_dir))
    d_cols, d_rows = duck_rows(con, sql)
    sn, sc, sh = table_digest(s_cols, s_rows)
    dn, dc, dh = table_digest(d_cols, d_rows)
    out = {"name": name, "rows": (sn, dn), "cols_match": sc == dc, "hash_match": sh == dh}
    out["ok"] = sn == dn and sc == dc and sh == dh
    if not out["ok"]:
        out["spark_cols"], out["duck_cols"] = sc, dc
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        s_set = sorted(repr(tuple(_norm(r[i]) for i in order_s)) for r in s_rows)
        d_set = sorted(repr(tuple(_norm(r[i]) for i in order_d)) for r in d_rows)
        only_s = sorted(set(s_set) - set(d_set))[:3]
        only_d = sorted(set(d_set) - set(s_set))[:3]
        out["only_spark"], out["only_duck"] = only_s, only_d
    return out


def main(argv: list[str]) -> int:
    sys.path[:0] = [".", "tests"]
    import __spark_entry__ as entry

    from tunedata.session import get_spark

    sf_dir = "/root/testdata/sf0.01"
    names = argv or sorted(entry.oracle_sql())
    spark = get_spark(shuffle_partitions=8)
    con = duck_connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, sf_dir, n, qs[n], sqls[n])
        except Exception as exc:  # report and continue
            r = {"name": n, "ok": False, "error": f"{type(exc).__name__}: {str(exc)[:400]}"}
        bad += not r["ok"]
        print(("OK  " if r["ok"] else "BAD ") + repr(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
