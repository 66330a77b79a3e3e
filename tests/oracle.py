"""Side-by-side comparison of queries with their SQL in DuckDB.

Run as ``python tests/oracle.py DIR [NAME ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(at: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute("SET memory_limit='10GB'")
    con.execute(f"SET temp_directory='{tempfile.gettempdir()}/oracle'")
    for p in Path(at).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, query, sql: str, at: str) -> str:
    """Empty if the query and its SQL give the same columns and rows, else the difference."""
    df = query(spark, at)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs = rows(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        only = [x for x in mine if x not in theirs][:3] if len(mine) < 20000 else []
        other = [x for x in theirs if x not in mine][:3] if len(mine) < 20000 else []
        return f"{len(mine)} and {len(theirs)} rows; only here {only}, only there {other}"
    return ""


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


if __name__ == "__main__":
    import __spark_entry__ as e

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    sql = e.oracle_sql()
    for name in sys.argv[2:] or list(e.queries()):
        began = time.time()
        try:
            if name in sql:
                print(name, compare(spark, con, e.queries()[name], sql[name], sys.argv[1]) or "ok", f"{time.time() - began:.1f}s", flush=True)
            else:
                print(name, "no SQL;", e.queries()[name](spark, sys.argv[1]).count(), "rows", f"{time.time() - began:.1f}s", flush=True)
        except Exception as x:  # noqa: BLE001
            print(name, "FAILED", str(x)[:1500], flush=True)
