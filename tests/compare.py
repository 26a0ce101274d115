"""Runs queries and their SQL oracles side by side and compares the rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return repr(float(value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str):
    """(spark rows, oracle rows, rows only in spark, rows only in oracle)."""
    mine = rows_of(spark_df.columns, spark_df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(spark_df.columns), (sorted(names), sorted(spark_df.columns))
    theirs = rows_of(names, cursor.fetchall())
    return sum(mine.values()), sum(theirs.values()), mine - theirs, theirs - mine


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from citeframe.session import local_session

    folder = sys.argv[1]
    only = sys.argv[2:]
    session = local_session(8, 8)
    db = connect(folder)
    oracles = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(session, folder)
            n, m, extra, missing = compare(df, db, oracles[name])
            ok = n == m and not extra and not missing
            print(f"{'ok  ' if ok else 'DIFF'} {name} spark={n} oracle={m} {time.time() - t0:.1f}s", flush=True)
            if not ok:
                bad += 1
                print("   only spark :", list(extra.items())[:3])
                print("   only oracle:", list(missing.items())[:3], flush=True)
        except Exception as exc:
            bad += 1
            print(f"FAIL {name} {time.time() - t0:.1f}s {type(exc).__name__}: {str(exc)[:700]}", flush=True)
    print("bad:", bad)
