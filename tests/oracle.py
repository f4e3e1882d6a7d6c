"""Compare registered queries with their SQL on one folder: ``python tests/oracle.py <folder> [name part ...]``."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr), sorted(columns)


def check(spark, con, fn, sql: str, folder: str):
    df = fn(spark, folder)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}: only here {sorted(set(got) - set(want), key=repr)[:3]} only sql {sorted(set(want) - set(got), key=repr)[:3]}", len(got)
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(diff)} rows differ, e.g. {diff[:2]}", len(got)
    return None, len(got)


def main() -> int:
    from docfields.session import local_session

    import __spark_entry__ as entry

    folder, parts = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(folder)
    bad = 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if parts and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in parts):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem, n = check(spark, con, fn, sqls[name], folder)
            else:
                n, problem = len(fn(spark, folder).collect()), None
        except Exception as e:  # report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} {time.time() - start:.1f}s {'' if name in sqls else '(no sql)'} {problem or ''}"[:1500], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
