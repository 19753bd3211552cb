"""The demonstration workloads run, at small sizes."""

import pytest

from keelson import scenarios


@pytest.mark.parametrize(
    ("name", "args", "rows"),
    [
        ("skew", (2000,), 101), ("straggler", (0.06,), 20), ("gc", (500,), 1), ("spill", (2000,), 2000), ("broadcast", (1000,), 1000), ("small_tasks", (), 1000),
        ("low_cpu", (0.01,), 20), ("scheduler_delay", (20,), 20), ("slow_serialization", (50,), 50), ("root_cause_skew", (2000,), None),
    ],
)
def test_workload(spark, name, args, rows):
    got = getattr(scenarios, name)(spark, *args)
    assert got == rows if rows else got > 1


def test_slow_queries(spark, tmp_path):
    many, cross, twice = scenarios.slow_queries(spark, str(tmp_path))
    assert many.count() == 50 and cross.count() == 10 and twice.count() == 10_000


def test_auto_fix(spark, tmp_path):
    runs = scenarios.auto_fix(spark, f"file://{tmp_path}/profiles", rows=20_000, small=2000, runs=3)
    assert [r["run"] for r in runs] == [1, 2, 3] and not runs[0]["hints"] and all(r["best_ms"] is None or r["best_ms"] > 0 for r in runs)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
