"""Compare registered queries with their SQL in DuckDB: ``tests/compare.py [sf_dir] [name prefix ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def table_of(arrow):
    """(sorted column names, type kinds, sorted rows) of an Arrow table."""
    names = sorted(arrow.column_names)
    kinds = {n: str(arrow.schema.field(n).type).replace("large_", "") for n in names}
    cols = [arrow.column(n).to_pylist() for n in names]
    rows = sorted((tuple(_plain(v) for v in r) for r in zip(*cols)), key=repr)
    return names, kinds, rows


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides agree on columns, types and every value."""
    got = table_of(spark_df.toArrow())
    want = table_of(con.execute(sql).to_arrow_table())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        return f"types {[(k, v, want[1][k]) for k, v in got[1].items() if v != want[1][k]]}"
    if len(got[2]) != len(want[2]):
        return f"rows {len(got[2])} != {len(want[2])}"
    bad = [(a, b) for a, b in zip(got[2], want[2]) if a != b]
    return f"{len(bad)} of {len(got[2])} rows differ, first {bad[0]}" if bad else None


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con = session(), connect(sf_dir)
    sql, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        began = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                note = difference(df, con, sql[name])
                kind = "sql"
            else:
                kind, n = "rows", df.count()
                note = None if n else "no rows"
        except Exception as e:  # report and go on
            kind, note = "error", f"{type(e).__name__}: {str(e)[:600]}"
        failed += note is not None
        print(f"{'ok  ' if note is None else 'FAIL'} {name} [{kind}] {time.time() - began:.1f}s {note or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(1 if main(where, sys.argv[2:]) else 0)
