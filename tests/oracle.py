"""Compare registered queries with their SQL on DuckDB. Run as a script for a report:

python tests/oracle.py [sf dir] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "is_integer") and not isinstance(value, int):
        return float(value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    data: pa.Table = df.toArrow()
    names = data.column_names
    return sorted(names), rows_of(names, zip(*[c.to_pylist() for c in data.columns])) if names else []


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(names), rows_of(names, found.fetchall())


def difference(spark_side, sql_side) -> str | None:
    """None when columns, row counts and all values agree exactly."""
    if spark_side[0] != sql_side[0]:
        return f"columns {spark_side[0]} / {sql_side[0]}"
    a, b = spark_side[1], sql_side[1]
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}; spark {a[:2]} sql {b[:2]}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ {spark_side[0]}: {wrong[:3]}" if wrong else None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from driverscope.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    con = connect(folder)
    sqls, bad = oracle_sql(), 0
    for name, run in queries().items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        begin = time.time()
        try:
            got = spark_rows(run(spark, folder))
            seconds = time.time() - begin
            verdict = difference(got, sql_rows(con, sqls[name])) if name in sqls else None
            state = "ok" if verdict is None else "DIFFERS " + verdict
            state += "" if name in sqls else " (rows only)"
        except Exception as problem:  # report and go on with the next query
            seconds, verdict, got = time.time() - begin, "error", ([], [])
            state = "ERROR " + str(problem)[:600]
        bad += verdict is not None
        print(f"{name}: {len(got[1])} rows {seconds:.1f}s {state}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
