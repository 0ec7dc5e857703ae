"""Runs registered queries next to their SQL twins on the same tables and compares the sorted rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)) if isinstance(v, (list, dict)) else "", _plain(v)) for v in row)


def _plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{v:+040.6f}" if math.isfinite(v) else str(v)
    return str(v)


def compare(spark, con, query, sql, folder) -> tuple[str, int]:
    """('', rows) when equal, else a description of the first difference."""
    got = query(spark, folder)
    columns = sorted(got.columns)
    start = time.time()
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    compare.spark_seconds = time.time() - start
    if sql is None:
        return "", len(rows)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}", len(rows)
    spots = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in spots) for r in result.fetchall()]
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}; got {rows[:2]} want {want[:2]}", len(rows)
    for a, b in zip(sorted(rows, key=_key), sorted(want, key=_key)):
        for c, x, y in zip(columns, a, b):
            if type(x) is not type(y) or (x != y):
                return f"{c}: {x!r} != {y!r} in {a} / {b}", len(rows)
    return "", len(rows)


def main() -> None:
    from wearline.plans import ORACLES, QUERIES
    from wearline.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("SPLIT"):  # force the plans for groups too large for one task
        spark.conf.set("spark.wearline.taskBytes", "0")
    con = connect(folder)
    bad = 0
    for name, query in QUERIES.items():
        if sys.argv[1:] and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, query, ORACLES.get(name), folder)
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", 0
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} {time.time() - start:.1f}s collect={getattr(compare, 'spark_seconds', 0):.1f}s {'' if name in ORACLES else '(no sql)'} {problem[:1800]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
