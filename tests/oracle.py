"""Runs a registered query and its oracle SQL and compares their rows.

As a script: ``python tests/oracle.py [--dir SF_DIR] [NAME...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _cell(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(_cell(x) for x in v)
    return str(v)


def rows_of(df) -> tuple[list[str], list[tuple]]:
    """Column names in order, and the rows sorted, cells as text."""
    cols = sorted(df.columns)
    return cols, sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())


def compare(spark, con, name: str, sf_dir: str) -> str:
    """"" if query and oracle agree, else what differs."""
    import __spark_entry__ as e

    got_cols, got = rows_of(e.queries()[name](spark, sf_dir))
    rel = con.sql(e.oracle_sql()[name])
    names = rel.columns
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    want = sorted(tuple(_cell(r[i]) for i in at) for r in rel.fetchall())
    if got_cols != cols:
        return f"columns {got_cols} against {cols}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(args.index("--dir") + 1) if "--dir" in args else "/root/testdata/sf0.01"
    names = [a for a in args if a != "--dir"] or sorted(entry.queries())
    spark, con = session(), duck(sf_dir)
    for name in names:
        began = time.time()
        try:
            if name in entry.oracle_sql():
                said = compare(spark, con, name, sf_dir) or "ok"
            else:
                df = entry.queries()[name](spark, sf_dir)
                said = f"no SQL; {df.count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {type(x).__name__}: {str(x)[:1500]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
