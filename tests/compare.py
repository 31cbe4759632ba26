"""Run registered queries in Spark and their check SQL in DuckDB, and compare all rows.

``python -m tests.compare [--sf DIR] [name …]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from workload import catalog  # noqa: E402
from workload.base import TABLES  # noqa: E402


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "item"):
        return _plain(v.item())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con, sf: str, name: str) -> tuple[bool, str]:
    fn, sql = catalog()[name]
    start = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return True, f"rows={len(got)} unchecked {took:.1f}s"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        have, asked = set(got), set(want)
        only = [r for r in got if r not in asked][:3], [r for r in want if r not in have][:3]
        return False, f"{len(got)} rows vs {len(want)}; {sorted(columns)} spark only {only[0]} check only {only[1]}"
    return True, f"rows={len(got)} {took:.1f}s"


def main(argv: list[str]) -> int:
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in argv or catalog():
        try:
            ok, note = compare(spark, con, sf, name)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note[:900], flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
