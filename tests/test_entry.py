"""The driver's contract, and core queries against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from keelson import queries as core

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="needs the driver's tables")


def normal(df):
    def value(v):
        if str(v) in ("None", "nan", "<NA>", "NaT"):
            return "null"
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(value(v) for v in r) for r in df.values.tolist()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_contract():
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", ["diff_changed_hash", "diff_summary", "diff_null_keys", "join_resilient_full", "split_broadcast_semi", "salt_null_keys", "hint_targeted_salt", "issue_skew", "root_causes_tasks", "stage_savings", "view_stragglers", "view_executors", "advisor_partitions", "suggestions_by_execution", "config_advice"])
def test_oracle(spark, duck, name):
    ours, theirs = core.QUERIES[name](spark, str(SF)).toPandas(), duck.execute(core.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and normal(ours) == normal(theirs)
