"""Compare every registered query with its SQL: ``python tests/check_oracles.py [folder] [names...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


SIMPLE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def compare(spark, con, build, sql, folder):
    """None if all is equal, else what differs."""
    df = build(spark, folder)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    expected = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    wrong = {
        f.name: (f.dataType.simpleString(), types[f.name]) for f in df.schema
        if SIMPLE.get(f.dataType.simpleString()) != types[f.name]
    }
    if wrong:
        return f"types differ: {wrong}"
    a, b = canonical(df.columns, got), canonical(names, expected)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None


def main():
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from millrace.session import build_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(folder), oracle_sql(), 0
    for name, build in queries().items():
        if args[1:] and name not in args[1:]:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, build, oracles[name], folder)
                note = "" if problem is None else problem
            else:
                rows = build(spark, folder).collect()
                note = f"rows only: {len(rows)}, e.g. {rows[:2]}"[:300]
                problem = None if rows else "no rows"
        except Exception as error:  # a broken query must not hide the others
            problem = note = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:26s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
