"""Compare registered queries with their SQL run by DuckDB over the same files."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from queries import REGISTRY  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def compare(spark, con, name: str, folder: str) -> str | None:
    """None when both agree, otherwise what differs."""
    found = REGISTRY[name]
    df = found.run(spark, folder)
    mine, columns = _rows(df.columns, [tuple(r) for r in df.collect()])
    if found.sql is None:
        return "no SQL to compare with"
    cursor = con.execute(found.sql)
    names = [d[0] for d in cursor.description]
    theirs, wanted = _rows(names, cursor.fetchall())
    if columns != wanted:
        return f"columns {columns} instead of {wanted}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows instead of {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"row {a} instead of {b}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    bad = 0
    for name in REGISTRY:
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} of {len(REGISTRY)} differ")
