"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

python tests/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if hasattr(value, "toArray"):
        value = list(value.toArray())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def differences(df, con, query: str) -> str | None:
    """None when both sides agree, else a short description."""
    spark_columns, spark_rows = df.columns, df.collect()
    result = con.execute(query)
    duck_columns = [d[0] for d in result.description]
    duck_rows = result.fetchall()
    if sorted(spark_columns) != sorted(duck_columns):
        return f"columns {sorted(spark_columns)} / {sorted(duck_columns)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} / {len(duck_rows)}"
    a, b = table(spark_columns, spark_rows), table(duck_columns, duck_rows)
    if a == b:
        return None
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}"


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from marquee import session

    spark = session.local()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracle:
                problem = differences(df, con, oracle[name])
                state = "same" if problem is None else "DIFFERENT: " + problem
            else:
                problem, rows = None, df.collect()
                state = f"{len(rows)} rows, first {rows[0] if rows else None}"[:200]
        except Exception as e:  # report and go on with the next query
            problem, state = "error", "ERROR: " + str(e).strip()[:600]
        failed += problem is not None
        print(f"{name:28s} {time.time() - start:6.1f}s  {state}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
