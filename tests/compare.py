"""Runs registered queries next to their SQL in DuckDB and compares the rows.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def sorted_rows(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows in a fixed order."""
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(plain, key=lambda r: [(v is not None, v if v is not None else 0) for v in r])


def difference(spark_df, con, sql: str) -> str | None:
    names, ours = sorted_rows(spark_df.columns, spark_df.collect())
    found = con.execute(sql)
    other, theirs = sorted_rows([c[0] for c in found.description], found.fetchall())
    if names != other:
        return f"columns {names} against {other}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    bad = [(x, y) for x, y in zip(ours, theirs) if x != y]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ, first {bad[0]}"
    kinds = [{type(v) for v in column if v is not None} for column in zip(*ours)]
    others = [{type(v) for v in column if v is not None} for column in zip(*theirs)]
    if kinds != others:
        return f"types {kinds} against {others}"
    return None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                found = difference(query(spark, sf_dir), con, sqls[name])
                state = "ok" if found is None else f"DIFFERS {found}"
            else:
                rows = len(query(spark, sf_dir).collect())
                state = f"rows only: {rows}"
        except Exception as error:  # noqa: BLE001
            state = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        failed += state.startswith(("DIFFERS", "FAILED"))
        print(f"{name:28s} {time.time() - start:6.1f}s  {state}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
