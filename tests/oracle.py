"""Compare registered queries with their SQL in DuckDB: python tests/oracle.py [DIR] [NAME...]."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def canonical(value, digits: int = 9):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.{digits}g}") + 0.0
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, canonical(v)) for k, v in value.items()))
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return value
    return str(value)


def rows(names: list[str], table: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in table), key=repr)


def compare(df, con, sql: str) -> str:
    """An empty string if both give the same columns and rows."""
    rel = con.sql(sql)
    mine, theirs = df.columns, rel.columns
    if sorted(mine) != sorted(theirs):
        return f"columns {sorted(mine)} and {sorted(theirs)}"
    a, b = rows(mine, [tuple(r) for r in df.collect()]), rows(theirs, rel.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {str(bad[0])[:600]}" if bad else ""


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in args or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            said = compare(df, con, sql[name]) if name in sql else f"no SQL; {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(said) and name in sql
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
