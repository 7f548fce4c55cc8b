"""Run queries next to their SQL and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

TABLES_ROOT = os.environ.get("TABLES_ROOT", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(frame_columns, rows):
    order = sorted(range(len(frame_columns)), key=lambda i: frame_columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """(seconds, rows, message); the message is empty when both sides agree."""
    began = time.time()
    frame = query(spark, sf_dir)
    got = frame.collect()
    seconds = time.time() - began
    if sql is None:
        return seconds, len(got), "" if got else "no rows"
    began = time.time()
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    sql_seconds = time.time() - began
    if sorted(columns) != sorted(frame.columns):
        return seconds, len(got), f"columns {sorted(frame.columns)} != {sorted(columns)}"
    mine, theirs = rows_of(frame.columns, got), rows_of(columns, want)
    if mine == theirs:
        return seconds, len(got), "" if sql_seconds < 30 else f"slow SQL {sql_seconds:.0f}s"
    only_mine = sorted(set(map(repr, mine)) - set(map(repr, theirs)))[:3]
    only_theirs = sorted(set(map(repr, theirs)) - set(map(repr, mine)))[:3]
    return seconds, len(got), f"{len(mine)} vs {len(theirs)} rows; mine {only_mine}; sql {only_theirs}"


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from foliograph.session import local_session

    sf_dir = f"{TABLES_ROOT}/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con = local_session("8"), connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            seconds, rows, message = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as problem:
            seconds, rows, message = 0.0, 0, f"{type(problem).__name__}: {str(problem)[:700]}"
        bad += bool(message)
        print(f"{'FAIL' if message else 'ok  '} {name:28} {seconds:6.2f}s {rows:8} {message}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
