"""Compare registered queries with their SQL: row count, column names and values, independent of row order."""
from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool):
        return f"b{x}"
    if isinstance(x, (float, Decimal)):
        return f"f{float(x):.6f}"
    return f"{type(x).__name__}:{x}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str) -> str:
    """'' when equal, else what differs."""
    df = fn(spark, sf_dir)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"rows {len(a)} / {len(b)}\n   spark {only_a}\n   sql   {only_b}"


if __name__ == "__main__":
    from tests.conftest import make_session

    import __spark_entry__ as entry

    sf = sys.argv[1]
    spark, con = make_session(), connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not sys.argv[2:] or any(p in n for p in sys.argv[2:])]
    bad = 0
    for n in names:
        t = time.time()
        try:
            if n in sqls:
                msg = compare(spark, con, sf, n, qs[n], sqls[n])
            else:
                msg = f"(no sql) {qs[n](spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(msg) and not msg.startswith("(no sql)")
        print(f"{'ok  ' if not msg or msg.startswith('(no') else 'FAIL'} {n} {time.time() - t:.1f}s {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
