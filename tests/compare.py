"""Run queries in Spark and DuckDB and compare the whole results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _cell(v: object) -> str:
    if v is None or v is pd.NA or v is pd.NaT:
        return "null"
    if isinstance(v, float):
        return "null" if v != v else repr(v + 0.0)
    return repr(v.item()) if hasattr(v, "item") else repr(v)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_seconds = time.time() - start
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} and {sorted(columns)}"
    types = dict(con.execute(f"select column_name, column_type from (describe {sql})").fetchall())
    note = " ".join(f"{c}:{t}/{types[c]}" for c, t in df.dtypes)
    if ours != theirs:
        diff = next(((a, b) for a, b in zip(ours, theirs) if a != b), None)
        return False, f"rows {len(ours)} and {len(theirs)}, first difference {str(diff)[:600]}"
    return True, f"(Spark {spark_seconds:.1f}s) {len(ours)} rows {note}"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    for name in names:
        start = time.time()
        try:
            fn = entry.queries()[name]
            if name in oracles:
                ok, note = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                ok, note = True, f"{len(fn(spark, sf_dir).collect())} rows, no SQL"
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__} {str(e)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)


if __name__ == "__main__":
    main()
