"""Run registered queries in Spark and DuckDB and compare whole results.

    python -m checks.compare [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from .oracles import ORACLES
from .queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def local_session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("deskflow")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in data)


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, key: str) -> str | None:
    """What differs between the two results, or None."""
    df = QUERIES[key](spark, sf_dir)
    ours = rows(df.columns, df.collect())
    if key not in ORACLES:
        return None if ours else "no rows"
    cursor = con.execute(ORACLES[key])
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    theirs = rows(names, cursor.fetchall())
    if ours != theirs:
        return (
            f"{sum(ours.values())} / {sum(theirs.values())} rows; only here "
            f"{[str(r)[:300] for r in (ours - theirs)][:2]}; only there {[str(r)[:300] for r in (theirs - ours)][:2]}"
        )
    return None


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for key in argv[1:] or QUERIES:
        start = time.time()
        try:
            found = difference(spark, con, sf_dir, key)
        except Exception as err:  # noqa: BLE001 - report and go on with the next key
            found = f"{type(err).__name__}: {str(err)[:1500]}"
        bad += found is not None
        note = "" if key in ORACLES else "(rows only) "
        print(f"{key:28s} {time.time() - start:6.2f}s {note}{'ok' if found is None else found}", flush=True)
    print(f"{bad} of {len(argv[1:] or QUERIES)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
