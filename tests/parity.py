"""Run registered queries on Spark and their oracles on DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def normal(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(row[i] for i in order) for row in rows)


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"{sum(got[1].values())} rows, no oracle, {took:.2f}s"
    start = time.time()
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = normal(columns, result.fetchall())
    oracle_took = time.time() - start
    kinds = dict(df.dtypes)
    types = {c[0]: str(c[1]) for c in result.description}
    note = f"{sum(got[1].values())} rows, {took:.2f}s, oracle {oracle_took:.2f}s"
    if got == want:
        return True, note
    missing, extra = want[1] - got[1], got[1] - want[1]
    return False, (
        f"{note}\n  columns {got[0]} / {want[0]}\n  {kinds}\n  {types}"
        f"\n  missing {sum(missing.values())}: {list(missing)[:3]}"
        f"\n  extra {sum(extra.values())}: {list(extra)[:3]}"
    )


def main() -> None:
    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names:
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)


if __name__ == "__main__":
    main()
