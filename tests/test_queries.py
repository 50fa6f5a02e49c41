from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check_oracle import plain  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from listingspark.plans.registry import TABLES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
# Covers every stage once; tools/check_oracle.py runs all of them.
CHOSEN = (
    "q1_integrity_issues", "q8_prepared_rows", "q14_manual_review", "q19_consolidated_rows", "p2_fold_assignment", "p3_continued_splits",
    "g2_subgroup_metrics", "g5_removal_verdicts", "g11_development_qualification", "e3_title_and_year", "e15_source_reconciliation",
    "q21_quota_selection", "st1_incremental_ingest", "g1_refused_metrics", "p2_missing_families",
)

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")


def test_contract():
    queries, oracle = contract.queries(), contract.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 90
    assert set(CHOSEN) <= set(oracle)


def test_entry_has_rows(spark):
    rows = contract.entry(spark).collect()
    assert rows and all(r["mae_pkr"] is not None for r in rows)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    expected = sorted((tuple(plain(dict(zip(columns, r))[n]) for n in sorted(columns)) for r in result.fetchall()), key=repr)
    frame = contract.queries()[name](spark, FOLDER)
    assert sorted(frame.columns) == sorted(columns)
    got = sorted((tuple(plain(r[n]) for n in sorted(columns)) for r in frame.collect()), key=repr)
    assert got == expected and got
