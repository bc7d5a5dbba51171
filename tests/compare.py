"""Run a registered query and its SQL side by side.

``python tests/compare.py <sf dir> [name ...]`` prints one line per query; with PLAIN_SESSION=1 in a session
without any of the library's settings.
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(directory: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, directory: str, build, sql: str | None) -> tuple[bool, str]:
    started = time.time()
    df = build(spark, directory)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return True, f"rows={len(got)} no sql {took:.1f}s"
    res = con.execute(sql)
    names, want = [d[0] for d in res.description], res.fetchall()
    a, b = _rows(df.columns, got), _rows(names, want)
    if a == b:
        return True, f"rows={len(got)} {took:.1f}s duckdb={time.time() - started - took:.1f}s"
    if a[0] != b[0]:
        return False, f"columns {a[0]} != {b[0]}"
    only_a = [r for r in a[1] if r not in set(b[1])][:3]
    only_b = [r for r in b[1] if r not in set(a[1])][:3]
    return False, f"rows {len(got)} / {len(want)}\n   spark {only_a}\n   sql   {only_b}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from tidemark import registry
    from tidemark.session import build_session

    if os.environ.get("PLAIN_SESSION"):
        session = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        session = build_session(
            master="local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g"
        )
    session.sparkContext.setLogLevel("ERROR")
    where, wanted = sys.argv[1], sys.argv[2:]
    con = connect(where)
    all_queries, all_sql = registry.queries(), registry.oracle_sql()
    bad = 0
    for name, build in all_queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(session, con, where, build, all_sql.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__} {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed", bad)
