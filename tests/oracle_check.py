"""Compare registered queries with their SQL on another engine: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> str:
    started = time.time()
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if sql is None:
        return f"{name}: {sum(mine.values())} rows, {spent:.1f}s, no check"
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"FAIL {name}: columns {sorted(df.columns)} vs {sorted(names)}"
    if mine != theirs:
        only_mine, only_theirs = list((mine - theirs).items()), list((theirs - mine).items())
        return (
            f"FAIL {name}: {sum(mine.values())} vs {sum(theirs.values())} rows, {len(only_mine)}/{len(only_theirs)} "
            f"differ; {sorted(df.columns)} mine {only_mine[:2]} theirs {only_theirs[:2]}"
        )
    return f"ok {name}: {sum(mine.values())} rows, {spent:.1f}s"


def main() -> int:
    import __spark_entry__ as entry
    from rentgrain.session import build_session

    scale, wanted = (sys.argv[1:2] or ["0.01"])[0], sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    spark = build_session("local[8]", "check", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            line = compare(spark, con, folder, name, query, entry.oracle_sql().get(name))
        except Exception as error:  # report and go on with the next query
            line = f"FAIL {name}: {type(error).__name__} {str(error)[:600]}"
        failed += line.startswith("FAIL")
        print(line, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
