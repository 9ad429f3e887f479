"""Run registered queries against their SQL: ``python tests/compare.py [sf_dir] [query ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when the frame and the SQL agree in columns and values, else what differs."""
    got = _rows(df.columns, df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    want = _rows(columns, cur.fetchall())
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:2] if len(got) < 20000 else []
    missing = [r for r in want if r not in set(got)][:2] if len(got) < 20000 else []
    return f"{len(got)} rows != {len(want)}; only here {extra}; only SQL {missing}"


if __name__ == "__main__":
    import __spark_entry__ as entry_points
    from rolesieve.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf), entry_points.oracle_sql(), 0
    for name, query in entry_points.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in sqls:
                verdict = difference(query(spark, sf), con, sqls[name]) or "ok"
            else:
                verdict = f"no SQL, {query(spark, sf).count()} rows"
        except Exception as exc:  # report and go on
            verdict = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += not verdict.startswith(("ok", "no SQL"))
        print(f"{name}: {verdict} ({time.time() - start:.1f}s)", flush=True)
    print("failed:", failed)
