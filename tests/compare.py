"""Run registered queries next to their reference SQL and compare whole results."""

from __future__ import annotations

import decimal
import glob
import os
import sys
import time

import duckdb

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)

from paystrata.sources.staging import staging_scope  # noqa: E402


def reference(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark, con, query, sql, folder) -> str | None:
    with staging_scope(spark):
        got = query(spark, folder)
        got_names, got_rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    cursor = con.execute(sql)
    want_names, want_rows = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} against {want_names}"
    if got_rows == want_rows:
        return None
    only_got = [r for r in got_rows if r not in set(want_rows)][:2]
    only_want = [r for r in want_rows if r not in set(got_rows)][:2]
    return f"{len(got_rows)} rows against {len(want_rows)}; {got_names}; only here {only_got}; only there {only_want}"


if __name__ == "__main__":
    from paystrata.catalog import queries
    from paystrata.oracle import oracle_sql
    from paystrata.session import local_session

    folder = sys.argv[1]
    spark = local_session(cores=8)
    con = reference(folder)
    sql = oracle_sql()
    bad = 0
    for name, query in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        begun = time.time()
        try:
            found = difference(spark, con, query, sql[name], folder) if name in sql else f"rows {query(spark, folder).count()}, no SQL"
        except Exception as error:  # report every query, then fail
            found = f"{type(error).__name__}: {str(error)[:900]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {time.time() - begun:6.2f}s {name} {found or ''}", flush=True)
    print("failures:", bad)
