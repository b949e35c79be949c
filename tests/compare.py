"""Run registered queries and their SQL side by side and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def sql_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def sql_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(row[i]) for i in order) for row in rows)


def difference(columns, rows, other_columns, other_rows) -> str | None:
    if sorted(columns) != sorted(other_columns):
        return f"columns {sorted(columns)} != {sorted(other_columns)}"
    mine, theirs = bag(columns, rows), bag(other_columns, other_rows)
    if mine == theirs:
        return None
    extra, lacking = mine - theirs, theirs - mine
    return (
        f"{sum(mine.values())} rows against {sum(theirs.values())}; "
        f"only Spark {sum(extra.values())}: {sorted(extra)[:3]}; only SQL {sum(lacking.values())}: {sorted(lacking)[:3]}"
    )


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    from gridcast import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    chosen = argv[1:] or list(entry.queries())
    spark = build_session(master="local[8]", **{"spark_sql_shuffle_partitions": 8, "spark_ui_enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, failures = sql_tables(sf_dir), 0
    for name in chosen:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            rows = df.collect()
            sql = entry.oracle_sql().get(name)
            problem = difference(df.columns, rows, *sql_rows(connection, sql)) if sql else None
            outcome = problem or ("ok" if sql else "rows only")
        except Exception as error:
            rows, problem = [], str(error)[:1500]
            outcome = f"{type(error).__name__}: {problem}"
        failures += bool(problem)
        print(f"{name:28s} {time.time() - start:6.2f}s {len(rows):7d} rows  {outcome}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
