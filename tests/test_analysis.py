import json

import pytest
from pyspark.sql import functions as F

from keelson import report
from keelson.analysis import config_advice, issues, root_causes
from keelson.analysis.suggestions import Execution, suggest
from keelson.config import MIB
from keelson.functions.text import format_bytes, format_duration
from keelson.sources import metrics

STAGE = dict(stage_id=1, attempt_id=0, name="s", status="COMPLETE", num_tasks=200, num_complete=200, num_failed=0, num_speculative=0, run_time_ms=100_000, cpu_time_ns=90_000_000_000, gc_time_ms=0, input_bytes=1000, shuffle_read_bytes=0, shuffle_write_bytes=0, remote_bytes_to_disk=0, mem_spill_bytes=0, disk_spill_bytes=0)
TASK = dict(stage_id=1, attempt_id=0, task_id=0, run_time_ms=1000.0, scheduler_delay_ms=0.0, deser_ms=0.0, result_ser_ms=0.0, result_bytes=0.0, fetch_wait_ms=0.0)


def found(spark, stage=None, tasks=(), executors=(), broadcasts=(), stages=None, cores=8):
    names = lambda ddl: [c.split()[0] for c in ddl.split(", ")]
    frame = lambda rows, ddl: spark.createDataFrame([tuple(r[c] for c in names(ddl)) for r in rows], ddl)
    stages = stages or [STAGE | (stage or {})]
    tasks = [TASK | t for t in tasks]
    out = issues.detect(frame(stages, issues.STAGES), frame(tasks, issues.TASKS), spark.createDataFrame(list(executors), issues.EXECUTORS), spark.createDataFrame(list(broadcasts), issues.BROADCASTS), cores=cores)
    return {(r["title"], r["severity"], r["savings_ms"]) for r in out.collect()}


@pytest.mark.parametrize(
    ("stage", "expected"),
    [
        ({"gc_time_ms": 10_000}, ("GC Pressure", "Warning", 10_000)),
        ({"gc_time_ms": 20_000}, ("GC Pressure", "Critical", 20_000)),
        ({"disk_spill_bytes": 60 * MIB}, ("Shuffle Spill", "Warning", 2000)),
        ({"num_speculative": 3}, ("Speculative Tasks", "Warning", 1500)),
        ({"num_tasks": 3}, ("Under-partitioned Stage", "Warning", None)),
        ({"shuffle_write_bytes": 5000}, ("Shuffle Amplification", "Warning", None)),
        ({"shuffle_write_bytes": 20_000}, ("Shuffle Amplification", "Critical", None)),
        ({"cpu_time_ns": 40_000_000_000}, ("Low CPU Utilization", "Warning", 60_000)),
        ({"cpu_time_ns": 20_000_000_000}, ("Low CPU Utilization", "Critical", 80_000)),
        ({"shuffle_read_bytes": 1, "remote_bytes_to_disk": 100 * MIB}, ("Disk Shuffle Read", "Warning", 4000)),
        ({"num_failed": 2}, ("Task Failures", "Critical", 1000)),
    ],
)
def test_stage_issues(spark, stage, expected):
    assert found(spark, stage) == {expected}


def test_quiet_stage(spark):
    assert found(spark) == set()
    assert found(spark, {"status": "FAILED", "gc_time_ms": 90_000}) == set()


@pytest.mark.parametrize(
    ("tasks", "expected"),
    [
        ([{}] * 9 + [{"run_time_ms": 3000.0}], {("Data Skew", "Warning", 2000)}),
        ([{}] * 9 + [{"run_time_ms": 5000.0}], {("Data Skew", "Critical", 4000)}),
        ([{"run_time_ms": float(x)} for x in (1000, 1000, 1000, 1100, 1100, 1100, 1100, 2000)], {("Straggler Tasks", "Warning", 750)}),
        ([{"run_time_ms": 100.0, "scheduler_delay_ms": 5.0}] * 4, {("Small Tasks (Over-partitioned)", "Warning", 1000)}),
        ([{"result_bytes": 50.0 * MIB}] * 4, {("Large Task Result", "Warning", None)}),
        ([{"deser_ms": 200.0}] * 4, {("High Task Deserialization", "Warning", 40_000)}),
        ([{"fetch_wait_ms": 200.0}] * 4, {("High Shuffle Fetch Wait", "Warning", 200)}),
        ([{"scheduler_delay_ms": 600.0}] * 4, {("High Scheduler Delay", "Warning", 120_000)}),
        ([{"result_ser_ms": 250.0}] * 4, {("Slow Result Serialization", "Warning", 50_000)}),
        ([{}] * 4, set()),
    ],
)
def test_task_issues(spark, tasks, expected):
    assert found(spark, tasks=tasks) == expected


def test_retry_and_application(spark):
    again = STAGE | {"attempt_id": 1}
    assert found(spark, stages=[STAGE, again]) == {("Stage Retry", "Critical", 100_000)}
    executors = [(str(i), True, 4, heap, 100) for i, heap in enumerate((10, 10, 100))]
    assert ("Executor Memory Skew", "Warning", None) in found(spark, executors=executors) and found(spark, executors=executors[:2]) == set()
    assert found(spark, broadcasts=[("broadcast_1", 200 * MIB)]) == {("Large Broadcast", "Warning", None)}


def test_rank_quantile(spark):
    tasks = spark.range(11).select(F.lit(1).alias("stage_id"), F.lit(0).alias("attempt_id"), *[F.col("id").cast("double").alias(m) for m in issues.QUANTILES])
    row = issues.task_quantiles(tasks).first()
    assert [row[f"run_time_ms_{q}"] for q in (25, 50, 75, 100)] == [2, 5, 8, 10]


def _issues(spark, *rows):
    return spark.createDataFrame([("Warning", s, t, "", "", ms, kind) for s, t, ms, kind in rows], issues.ISSUES)


def test_root_causes(spark):
    df = _issues(spark, (1, "Data Skew", 100, "Wall-clock"), (1, "GC Pressure", 70, "Compute"), (1, "Shuffle Spill", 50, "I/O"), (2, "GC Pressure", 10, "Compute"), (2, "Disk Shuffle Read", 5, "I/O"), (3, "Slow Result Serialization", 1, "Compute"))
    out = {r["name"]: (r["stages"], r["titles"], r["wall_ms"], r["compute_ms"]) for r in root_causes.root_causes(df).collect()}
    assert out == {"Uneven Data Distribution": ([1], ["Data Skew", "GC Pressure", "Shuffle Spill"], 100, 70), "Memory Pressure": ([2], ["Disk Shuffle Read", "GC Pressure"], 0, 10)}
    assert [r["title"] for r in root_causes.unclustered(df).collect()] == ["Slow Result Serialization"]


def test_root_cause_across_stages(spark):
    df = _issues(spark, (1, "Task Failures", 5, "Compute"), (2, "Stage Retry", 9, "Compute"), (None, "Executor Memory Skew", None, ""))
    out = root_causes.root_causes(df).collect()
    assert [(r["name"], r["stages"], r["compute_ms"]) for r in out] == [("Node / Executor Instability", [1, 2], 9)]
    assert root_causes.root_causes(df.limit(0)).count() == 0


SMJ = "SortMergeJoin [a#1], [b#2], Inner\n:- Sort [a#1 ASC]\n:  +- Exchange hashpartitioning(a#1, 200)\n:     +- FileScan parquet [a#1] PartitionFilters: [], PushedFilters: [IsNotNull(a)], DataFilters: [isnotnull(a#1)], Location: InMemoryFileIndex[file:/x]\n+- Sort [b#2 ASC]\n   +- Exchange hashpartitioning(b#2, 200)\n      +- FileScan parquet [b#2] PartitionFilters: [], PushedFilters: [], DataFilters: [], Location: InMemoryFileIndex[file:/x]"


def titles(plan, partitions=200, **more):
    return {(s.title, s.severity) for s in suggest(Execution(1, plan, frozenset({1}), **more), partitions)}


def test_suggestions():
    got = titles(SMJ, shuffle_write={1: 5 * MIB}, input_bytes={1: 2 << 30})
    assert got == {("Broadcast Join Candidate", "Critical"), ("AQE Not Enabled", "Info"), ("Missing Partition Pruning", "Warning"), ("Repeated Table Scan", "Warning"), ("Shuffle Partition Tuning", "Warning")}
    assert ("Broadcast Join Candidate", "Warning") in titles(SMJ, shuffle_write={1: 50 * MIB}) and not any(t == "Broadcast Join Candidate" for t, _ in titles(SMJ, shuffle_write={1: 500 * MIB}))
    assert ("AQE Not Enabled", "Warning") in titles(SMJ, issue_titles=frozenset({"Data Skew"}))
    assert not any(t == "Missing Partition Pruning" for t, _ in titles(SMJ, input_bytes={1: 1 << 20}))
    assert titles("AdaptiveSparkPlan isFinalPlan=true\n" + SMJ) == {("Missing Partition Pruning", "Warning"), ("Repeated Table Scan", "Warning")}
    assert ("Cartesian Product", "Critical") in titles("CartesianProduct\n+- Scan csv [a] DataFilters: []") and ("Suboptimal File Format", "Info") in titles("FileScan csv [a] PushedFilters: []")
    assert ("Python UDF Detected", "Warning") in titles("ArrowEvalPython [f(a)]\n+- BatchEvalPython [g(a)]")
    assert ("Excessive Shuffles", "Warning") in titles("Exchange a\n" * 5, shuffle_write={1: 250 * MIB}) and ("Excessive Shuffles", "Warning") not in titles("Exchange a\n" * 4)
    assert ("Collect on Large Dataset", "Warning") in titles("CollectLimit 5", input_bytes={1: 100 * MIB}) and ("Collect on Large Dataset", "Critical") in titles("GlobalLimit 5", input_bytes={1: 1025 * MIB})
    assert titles("") == set()


def advice(*rows, **props):
    found = [{"severity": s, "title": t, "savings_ms": ms} for s, t, ms in rows]
    return {r.config_key: (r.severity, r.savings_ms) for r in config_advice.advise(found, {k.replace("_", "."): v for k, v in props.items()})}


def test_config_advice():
    assert advice() == {}
    gc = advice(("Critical", "GC Pressure", 10))
    assert gc["spark.executor.memory"] == ("Critical", 10) and gc["spark.serializer"] == ("Info", None) and gc["spark.memory.offHeap.enabled"][0] == "Critical"
    spill = advice(("Critical", "GC Pressure", 10), ("Warning", "Shuffle Spill", 20), spark_memory_fraction="0.4")
    assert spill["spark.executor.memory"] == ("Warning", 20) and spill["spark.memory.fraction"] == ("Warning", 20)
    assert "spark.memory.fraction" not in advice(("Warning", "Shuffle Spill", 20))
    assert set(advice(("Warning", "Straggler Tasks", 1))) == {"spark.speculation"} and advice(("Warning", "Straggler Tasks", 1), spark_speculation="true") == {}
    assert advice(("Warning", "High Shuffle Fetch Wait", 1)) == {"spark.reducer.maxSizeInFlight": ("Warning", 1), "spark.shuffle.service.enabled": ("Info", None)}
    assert set(advice(("Warning", "Disk Shuffle Read", 1))) == {"spark.maxRemoteBlockSizeFetchToMem"} and set(advice(("Critical", "Stage Retry", 0))) == {"spark.executor.memory"}
    assert advice(("Warning", "Slow Result Serialization", 7)) == {"spark.serializer": ("Warning", 7)} and advice(("Warning", "Slow Result Serialization", 7), spark_serializer="org.apache.spark.serializer.KryoSerializer") == {}


def test_live_metrics_and_report(spark):
    spark.range(0, 1000, 1, 3).groupBy((F.col("id") % 7).alias("k")).count().collect()
    m = metrics.from_session(spark)
    assert m.stages.count() > 0 and m.tasks.count() > 0 and m.executors.count() == 1 and m.executions.count() > 0
    tables = report.report(spark, m)
    page = report.to_html({k: tables[k] for k in ("Overview", "Stages", "Suggestions")})
    assert list(tables)[:3] == ["Overview", "Issues", "Root causes"] and page.count("<h2>") == 3
    for name in issues.VIEWS:
        issues.view(name, m.stages, m.tasks).limit(1).collect()


def test_event_log(spark, tmp_path):
    task = lambda i, ms: {"Event": "SparkListenerTaskEnd", "Stage ID": 0, "Stage Attempt ID": 0, "Executor ID": "x", "Task Info": {"Task ID": i, "Launch Time": 0, "Finish Time": ms + 5, "Failed": False, "Killed": False, "Speculative": False}, "Task Metrics": {"Executor Run Time": ms, "Executor CPU Time": ms * 1_000_000, "JVM GC Time": ms // 2, "Executor Deserialize Time": 0, "Result Serialization Time": 0, "Result Size": 9, "Memory Bytes Spilled": 0, "Disk Bytes Spilled": 0, "Input Metrics": {"Bytes Read": 3}, "Shuffle Read Metrics": {"Fetch Wait Time": 0, "Remote Bytes Read": 0, "Local Bytes Read": 0, "Remote Bytes Read To Disk": 0}, "Shuffle Write Metrics": {"Shuffle Bytes Written": 1}}}
    stage = {"Stage ID": 0, "Stage Attempt ID": 0, "Stage Name": "n", "Number of Tasks": 3}
    events = [
        {"Event": "SparkListenerEnvironmentUpdate", "Spark Properties": {"a": "b"}},
        {"Event": "SparkListenerExecutorAdded", "Executor ID": "x", "Executor Info": {"Total Cores": 4}},
        {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 3, "physicalPlanDescription": "plan", "sparkPlanInfo": {"nodeName": "BroadcastExchange", "metrics": [{"name": "data size", "accumulatorId": 77}]}},
        {"Event": "SparkListenerJobStart", "Job ID": 1, "Stage IDs": [0], "Properties": {"spark.sql.execution.id": "3"}},
        {"Event": "SparkListenerStageSubmitted", "Stage Info": stage},
        *(task(i, ms) for i, ms in enumerate((100, 100, 900))),
        {"Event": "SparkListenerStageCompleted", "Stage Info": stage | {"Completion Time": 5}},
        {"Event": "org.apache.spark.sql.execution.ui.SparkListenerDriverAccumUpdates", "executionId": 3, "accumUpdates": [[77, 300 * MIB], [78, 1]]},
    ]
    path = tmp_path / "log"
    path.write_text("\n".join(json.dumps(e) for e in events))
    m = metrics.from_event_log(spark, str(path))
    s = m.stages.first()
    assert (s["status"], s["num_tasks"], s["num_complete"], s["run_time_ms"], s["cpu_time_ns"], s["gc_time_ms"], s["input_bytes"], s["shuffle_write_bytes"]) == ("COMPLETE", 3, 3, 1100, 1_100_000_000, 550, 9, 3)
    assert sorted(r["scheduler_delay_ms"] for r in m.tasks.collect()) == [5.0, 5.0, 5.0] and m.properties == {"a": "b"}
    assert [tuple(r) for r in m.broadcasts.collect()] == [("broadcast_77", 300 * MIB)] and [tuple(r) for r in m.executions.collect()] == [(3, "plan", [0])]
    got = {r["title"] for r in issues.detect(m.stages, m.tasks, m.executors, m.broadcasts).collect()}
    assert {"Data Skew", "GC Pressure", "Large Broadcast"} <= got


def test_formats():
    assert (format_bytes(5 << 30), format_bytes(1536), format_bytes(7)) == ("5.00 GB", "1.50 KB", "7 B")
    assert (format_duration(7_200_000), format_duration(90_000), format_duration(1500), format_duration(5)) == ("2.00 h", "1.50 min", "1.50 s", "5 ms") and metrics.parse_size("total (min, med, max)\n4.0 MiB (1 B)") == 4 * MIB
