"""Compare registered queries with their check SQL in DuckDB.

Usage: python tests/oracle.py [--sf sf0.01] [name or prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if hasattr(v, "asDict"):
        return {k: _plain(x) for k, x in v.asDict().items()}
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        ([_plain(r[i]) for i in order] for r in rows), key=lambda r: [str(x) for x in r]
    )


def _close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark, con, sf_dir, run, sql):
    """(ok, message) of one query."""
    df = run(spark, sf_dir)
    names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(got)} rows, no check SQL"
    cur = con.execute(sql)
    want_names, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return False, f"columns {names} != {want_names}"
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not all(_close(a, b) for a, b in zip(g, w))]
    if bad:
        return False, f"{len(bad)}/{len(got)} rows differ, e.g.\n    {names}\n    spark {bad[0][0]}\n    sql   {bad[0][1]}"
    types = {i: (type(g[i]).__name__, type(w[i]).__name__) for g, w in zip(got, want) for i in range(len(names))
             if g[i] is not None and w[i] is not None and type(g[i]) is not type(w[i])}
    note = "; types " + str({names[i]: t for i, t in types.items()}) if types else ""
    return True, f"{len(got)} rows{note}"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    args = [a for a in sys.argv[1:]]
    sf = "sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    sf_dir = f"/root/testdata/{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = e.queries(), e.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            ok, msg = compare(spark, con, sf_dir, run, sql.get(name))
        except Exception as error:  # report and go on with the next query
            ok, msg = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {msg}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
