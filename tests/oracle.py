"""Compare registered queries with their SQL on the same tables.

``python tests/oracle.py [sf_dir] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


_KINDS = {"tinyint": "int", "smallint": "int", "integer": "int", "varchar": "string", "timestamp": "timestamp_ntz"}


def differences(spark_df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs: column names, types, row count, values (bit for bit)."""
    result = con.execute(sql)
    sql_names = [d[0] for d in result.description]
    sql_types = {d[0]: str(d[1]).lower() for d in result.description}
    sql_rows = _rows(sql_names, result.fetchall())
    names = spark_df.columns
    if sorted(names) != sorted(sql_names):
        return [f"columns {sorted(names)} and {sorted(sql_names)}"]
    found = []
    for f in spark_df.schema.fields:
        theirs = _KINDS.get(sql_types[f.name], sql_types[f.name])
        if f.dataType.simpleString() != theirs:
            found.append(f"{f.name} is {f.dataType.simpleString()} and {theirs}")
    rows = _rows(names, spark_df.collect())
    if len(rows) != len(sql_rows):
        found.append(f"{len(rows)} and {len(sql_rows)} rows")
    else:
        wrong = [(a, b) for a, b in zip(rows, sql_rows) if a != b]
        if wrong:
            found.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return found


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tidemark.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    chosen = argv[1:] or list(entry.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            found = differences(df, con, sql[name]) if name in sql else []
            note = "ok" if name in sql else f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            found, note = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        bad += bool(found)
        print(f"{time.time() - start:6.2f}s {name}: {'; '.join(found) or note}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
