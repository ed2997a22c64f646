"""Run a named query and its SQL twin on the same tables and compare the rows."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(int(v)))
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else repr(v + 0.0))
    if isinstance(v, int):
        return (1, str(v))
    return (1, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """Empty string when equal, else what differs."""
    t = time.time()
    df = fn(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    spent = time.time() - t
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    theirs = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return spent, f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return spent, f"rows {len(mine)} != {len(theirs)}"
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if not bad:
        return spent, ""
    return spent, f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}"


def main(argv):
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from meterlens.session import local_session

    sf_dir = f"/root/testdata/{argv[1]}"
    wanted = argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            if name in oracles:
                spent, diff = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                t = time.time()
                n = len(fn(spark, sf_dir).collect())
                spent, diff = time.time() - t, "" if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001
            spent, diff = 0.0, f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {spent:6.2f}s {name} {diff}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    import sys

    sys.exit(1 if main(sys.argv) else 0)
