"""Side-by-side check of the queries against their SQL.

Run as ``python tests/compare.py SF_DIR [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, con, name: str, build, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = build(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"{g} / {w}"
    return None if got else "no rows on either side"


def main() -> int:
    from sheetloom.session import build_session

    import __spark_entry__ as entry

    sf_dir, only = sys.argv[1], set(sys.argv[2:])
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    sql = entry.oracle_sql()
    for name, build in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            found = difference(spark, con, name, build, sql[name], sf_dir) if name in sql else f"rows only: {build(spark, sf_dir).count()}"
        except Exception as error:
            found = str(error)[:500]
        bad += found is not None
        print(f"{name:28s} {time.time() - start:7.2f}  {found or 'same'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
