"""Run registered queries next to their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

from caseloom.plans.views import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """What differs, or None where columns and rows agree."""
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got == want:
        return None
    only_got = sorted(set(got) - set(want))[:2]
    only_want = sorted(set(want) - set(got))[:2]
    return f"rows {len(got)} vs {len(want)}\n   spark: {only_got}\n   sql:   {only_want}"


def main(sf_dir: str, wanted: list[str]) -> int:
    from caseloom import build_session
    from caseloom.plans.catalog import ORACLES, QUERIES

    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            frame = run(spark, sf_dir)
            built = time.time() - started
            if name in ORACLES:
                result = difference(frame, con, ORACLES[name])
            else:
                result = None if frame.columns else "no columns"
                print(f"     rows {frame.count()}", flush=True)
        except Exception as error:  # noqa: BLE001 - a report of every failing query
            result, built = f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        bad += result is not None
        print(f"{'FAIL' if result else 'ok  '} {name} build {built:.1f}s total {time.time() - started:.1f}s {result or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
