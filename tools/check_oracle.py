"""Compare registered queries with their SQL in DuckDB: names, row counts, values.

Usage: python tools/check_oracle.py [scale folder] [query name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
from pyspark.sql import SparkSession

from listingspark.plans import catalog
from listingspark.plans.registry import TABLES
from listingspark.session import configured


def plain(value):
    if isinstance(value, dict):
        return tuple((key, plain(item)) for key, item in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(item) for item in value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if hasattr(value, "as_tuple"):
        return f"{float(value):.9g}"
    return value


def kind(value) -> str:
    return type(value).__name__


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = (
        configured(SparkSession.builder.master("local[8]").appName("check"))
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name, query in catalog.queries().items():
        if prefixes and not any(name.startswith(prefix) for prefix in prefixes):
            continue
        started = time.time()
        try:
            frame = query(spark, folder)
            rows = [row.asDict(recursive=True) for row in frame.collect()]
            took = time.time() - started
            names = frame.columns
            if not query.sql:
                print(f"rows  {name}: {len(rows)} rows {took:.1f}s", flush=True)
                bad += not rows
                continue
            started = time.time()
            result = con.execute(query.sql)
            columns = [item[0] for item in result.description]
            expected = [dict(zip(columns, row)) for row in result.fetchall()]
            sql_took = time.time() - started
            problem = None
            if sorted(columns) != sorted(names):
                problem = f"columns {sorted(names)} vs {sorted(columns)}"
            elif len(rows) != len(expected):
                problem = f"rows {len(rows)} vs {len(expected)}"
            order = sorted(names)
            if problem is None:
                left = sorted((tuple(plain(row[n]) for n in order) for row in rows), key=repr)
                right = sorted((tuple(plain(row[n]) for n in order) for row in expected), key=repr)
                differing = [(a, b) for a, b in zip(left, right) if a != b]
                if differing:
                    problem = f"{len(differing)} rows differ, first {order}\n   spark {differing[0][0]}\n   sql   {differing[0][1]}"
                else:
                    kinds = [(n, {kind(r[n]) for r in rows if r[n] is not None}, {kind(r[n]) for r in expected if r[n] is not None}) for n in order]
                    mixed = [item for item in kinds if item[1] != item[2]]
                    if mixed:
                        problem = f"types {mixed}"
            if problem is None and not rows:
                problem = "no rows"
            bad += problem is not None
            print(f"{'ok   ' if problem is None else 'BAD  '} {name}: {len(rows)} rows {took:.1f}s (sql {sql_took:.1f}s) {problem or ''}", flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(error).__name__}: {str(error)[:1500]}", flush=True)
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
