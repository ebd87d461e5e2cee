"""Runs queries beside their SQL, as rows without order."""

from __future__ import annotations

import glob
import os
import signal
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    import datetime
    import decimal
    import math

    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in v.items()) + "}"
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


def differences(spark, con, sf_dir, query, sql):
    """'' if the query and the SQL give the same rows, else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if got == want:
        return ""
    in_got, in_want = set(got), set(want)
    a, b = [x for x in got if x not in in_want], [x for x in want if x not in in_got]
    return f"{len(got)} and {len(want)} rows; only Spark {len(a)}: {a[:2]}; only SQL {len(b)}: {b[:2]}"


LIMIT_S = 60


def too_long(*_):
    raise TimeoutError(f"over {LIMIT_S} s")


def main(names, sf_dir="/root/testdata/sf0.01"):
    import __spark_entry__ as e
    from tests.conftest import make_session

    signal.signal(signal.SIGALRM, too_long)
    spark = make_session()
    con = duck(sf_dir)
    queries, sql = e.queries(), e.oracle_sql()
    bad = 0
    for name in [n for n in queries if any(x in (n, "all") or (x[-1] == "*" and n.startswith(x[:-1])) for x in names)]:
        t = time.time()
        signal.alarm(LIMIT_S)
        try:
            if name in sql:
                said = differences(spark, con, sf_dir, queries[name], sql[name])
            else:
                df = queries[name](spark, sf_dir)
                said = f"no SQL; {len(df.collect())} rows" if True else ""
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {str(x)[:1500]}"
        signal.alarm(0)
        ok = not said or said.startswith("no SQL")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t:.1f}s {said}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    os.chdir(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sys.path.insert(0, os.getcwd())
    assert glob.glob("/root/testdata/*")
    sys.exit(main(sys.argv[1:] or ["all"]))
