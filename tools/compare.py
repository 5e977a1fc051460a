"""Compare registered queries with their SQL: ``python tools/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabquest.registry import all_oracles, all_queries  # noqa: E402
from tabquest.registry.common import TABLES  # noqa: E402
from tabquest.session import local_session  # noqa: E402


def oracle_connection(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(connection, sql: str):
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), sorted_rows(columns, result.fetchall())


def main(sf_dir: str, names: list[str]) -> int:
    spark, connection = local_session("compare", "8"), oracle_connection(sf_dir)
    failed = 0
    for name, query in all_queries().items():
        if names and name not in names:
            continue
        started = time.perf_counter()
        try:
            df = query(spark, sf_dir)
            ours = spark_rows(df)
            spent = time.perf_counter() - started
            columns, theirs = oracle_rows(connection, all_oracles()[name])
            sql_spent = time.perf_counter() - started - spent
        except Exception as problem:
            failed += 1
            print(f"ERROR {name}: {str(problem)[:1500]}", flush=True)
            continue
        same = ours == theirs and sorted(df.columns) == columns
        failed += not same
        print(f"{'ok   ' if same else 'DIFF '} {name} rows={len(ours)}/{len(theirs)} {spent:.2f}s sql {sql_spent:.2f}s", flush=True)
        if not same:
            print("   columns", sorted(df.columns), columns)
            ours_set, theirs_set = set(map(repr, ours)), set(map(repr, theirs))
            print("   only here ", [x[:400] for x in sorted(ours_set - theirs_set)[:3]])
            print("   only there", [x[:400] for x in sorted(theirs_set - ours_set)[:3]])
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
