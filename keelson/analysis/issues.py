"""Issues of finished or running stages, found by DataFrame queries over tables of run-time metrics.

Inputs have the columns of `STAGES`, `TASKS`, `EXECUTORS` and `BROADCASTS`; outputs those of `ISSUES`. They may come from an
event log, a live session (`sources.metrics`), or any table with these columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MIB, IssueSettings

STAGES = "stage_id int, attempt_id int, name string, status string, num_tasks int, num_complete int, num_failed int, num_speculative int, run_time_ms long, cpu_time_ns long, gc_time_ms long, input_bytes long, shuffle_read_bytes long, shuffle_write_bytes long, remote_bytes_to_disk long, mem_spill_bytes long, disk_spill_bytes long"
TASKS = "stage_id int, attempt_id int, task_id long, run_time_ms double, scheduler_delay_ms double, deser_ms double, result_ser_ms double, result_bytes double, fetch_wait_ms double"
EXECUTORS = "executor_id string, is_active boolean, total_cores int, peak_jvm_heap long, max_memory long"
BROADCASTS = "name string, bytes long"
ISSUES = "severity string, stage_id int, title string, description string, detail_path string, savings_ms long, savings_type string"
WALL, COMPUTE, IO, SCHEDULING = "Wall-clock", "Compute", "I/O", "Scheduling overhead"
#: Disk speed for estimates of spilled bytes, written and read: bytes a second. Fixed value.
DISK_SPEED = 50 * MIB
#: Task metrics and the quantiles of them that detectors use.
QUANTILES = {"run_time_ms": (0.25, 0.5, 0.75, 1.0), "scheduler_delay_ms": (0.5, 0.95), "deser_ms": (0.95,), "result_ser_ms": (0.95,), "result_bytes": (0.95,), "fetch_wait_ms": (0.5,)}


def task_quantiles(tasks: DataFrame) -> DataFrame:
    """A row per stage attempt: <metric>_<percent> for each quantile of QUANTILES.

    A quantile q of n values is number min(int(q n), n - 1) in their order, as Spark's own summaries have it. Values are
    counted, and the counts summed in order, so that no stage's tasks meet in one row.
    """
    stage = ["stage_id", "attempt_id"]
    values = tasks.select(*stage, *[F.col(m).cast("double").alias(m) for m in QUANTILES]).unpivot(stage, list(QUANTILES), "metric", "value")
    values = values.groupBy(*stage, "metric", "value").agg(F.count("value").alias("n"))
    own = Window.partitionBy(*stage, "metric")
    values = values.withColumns({"upto": F.sum("n").over(own.orderBy("value")), "all": F.sum("n").over(own)})

    def quantile(metric: str, q: float) -> Column:
        place = F.least(F.floor(F.col("all") * F.lit(q)), F.col("all") - 1) + 1
        return F.min(F.when((F.col("metric") == metric) & (F.col("upto") >= place), F.col("value")))

    return values.groupBy(*stage).agg(*[quantile(m, q).alias(f"{m}_{int(q * 100)}") for m, qs in QUANTILES.items() for q in qs])


def latest_attempts(stages: DataFrame) -> DataFrame:
    """The latest attempt of each complete or active stage."""
    latest = F.row_number().over(Window.partitionBy("stage_id").orderBy(F.desc("attempt_id")))
    return stages.where(F.col("status").isin("COMPLETE", "ACTIVE")).withColumn("_latest", latest).where("_latest = 1").drop("_latest")


@dataclass(frozen=True)
class Detector:
    """A kind of issue: when it holds, its severity, what mending it could save, and the page that shows it."""

    title: str
    when: Column
    severity: Column
    savings: Column
    savings_type: str
    path: str
    description: Column


def _warning(critical: Column | None = None) -> Column:
    return F.lit("Warning") if critical is None else F.when(critical, F.lit("Critical")).otherwise(F.lit("Warning"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _text(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


def _disk_ms(bytes_: Column) -> Column:
    """Written once and read once; whole seconds, as an integer division gives them."""
    return F.floor(bytes_ * 2 / DISK_SPEED) * 1000


def stage_detectors(s: IssueSettings, active_cores: int) -> list[Detector]:
    """Over latest stage attempts with task quantiles and `avg_task_ms`."""
    c, none = F.col, F.lit(None).cast("long")
    gc = _ratio(c("gc_time_ms"), c("run_time_ms"))
    cpu_ms = c("cpu_time_ns") / 1e6
    cpu = _ratio(cpu_ms, c("run_time_ms"))
    amplified = _ratio(c("shuffle_write_bytes"), c("input_bytes"))
    skew = _ratio(c("run_time_ms_100"), c("run_time_ms_50"))
    fence = c("run_time_ms_75") + s.straggler_iqr_factor * (c("run_time_ms_75") - c("run_time_ms_25"))
    fetch = _ratio(c("fetch_wait_ms_50"), c("run_time_ms_50"))
    delay = _ratio(c("scheduler_delay_ms_50"), c("run_time_ms_50"))
    return [
        Detector("GC Pressure", gc >= s.gc_ratio, _warning(gc >= 0.20), c("gc_time_ms"), COMPUTE, "gc", _text("%.0f %% of run time is garbage collection", gc * 100)),
        Detector("Shuffle Spill", c("disk_spill_bytes") > 0, _warning(), _disk_ms(c("disk_spill_bytes")), IO, "spill", _text("%.1f MiB spilled to disk", c("disk_spill_bytes") / MIB)),
        Detector("Speculative Tasks", c("num_speculative") > 0, _warning(), c("num_speculative") * c("avg_task_ms"), COMPUTE, "stability", _text("%.0f tasks ran speculatively", c("num_speculative"))),
        Detector("Under-partitioned Stage", (c("num_tasks") > 0) & (c("num_tasks") < max(int(active_cores * s.under_partition_ratio), 2)), _warning(), none, "", "partitioning", _text(f"%.0f tasks for {active_cores} cores", c("num_tasks"))),
        Detector("Shuffle Amplification", (c("shuffle_write_bytes") > 0) & (amplified >= s.shuffle_amplify_ratio), _warning(amplified >= 20), none, "", "partitioning", _text("shuffled %.1f times the bytes read", amplified)),
        Detector("Low CPU Utilization", (c("run_time_ms") >= s.low_cpu_min_run_ms) & (c("cpu_time_ns") > 0) & (cpu < s.low_cpu_ratio), _warning(cpu < 0.25), c("run_time_ms") - cpu_ms, COMPUTE, "partitioning", _text("CPU is used for %.0f %% of run time", cpu * 100)),
        Detector("Disk Shuffle Read", (c("shuffle_read_bytes") > 0) & (c("remote_bytes_to_disk") >= s.disk_shuffle_read_min_mb * MIB), _warning(), _disk_ms(c("remote_bytes_to_disk")), IO, "spill", _text("%.1f MiB fetched to disk", c("remote_bytes_to_disk") / MIB)),
        Detector("Data Skew", skew >= s.skew_multiplier, _warning(skew >= 5.0), c("run_time_ms_100") - c("run_time_ms_50"), WALL, "skew", _text("the longest task takes %.1f times the median", skew)),
        Detector("Straggler Tasks", (c("run_time_ms_75") > c("run_time_ms_25")) & (c("run_time_ms_100") > fence), _warning(), c("run_time_ms_100") - fence, WALL, "stragglers", _text("the longest task takes %.0f ms, the fence is %.0f ms", c("run_time_ms_100"), fence)),
        Detector("Small Tasks (Over-partitioned)", (c("num_tasks") >= s.small_task_min_count) & (c("run_time_ms_50") < s.small_task_median_ms), _warning(), c("scheduler_delay_ms_50") * c("num_tasks"), SCHEDULING, "partitioning", _text("%.0f tasks with a median of %.0f ms", c("num_tasks"), c("run_time_ms_50"))),
        Detector("Large Task Result", c("result_bytes_95") >= s.large_result_mb * MIB, _warning(), none, "", "stability", _text("results of %.1f MiB", c("result_bytes_95") / MIB)),
        Detector("High Task Deserialization", c("deser_ms_95") >= s.high_deser_ms, _warning(), c("deser_ms_95") * c("num_tasks"), COMPUTE, "stability", _text("%.0f ms to deserialize a task", c("deser_ms_95"))),
        Detector("High Shuffle Fetch Wait", fetch >= s.fetch_wait_ratio, _warning(), c("fetch_wait_ms_50"), WALL, "stability", _text("%.0f %% of a task's time is waiting for shuffles", fetch * 100)),
        Detector("High Scheduler Delay", (c("scheduler_delay_ms_95") >= s.high_scheduler_delay_ms) & (delay >= s.scheduler_delay_ratio), _warning(), c("scheduler_delay_ms_95") * c("num_tasks"), SCHEDULING, "partitioning", _text("tasks wait %.0f ms for the scheduler", c("scheduler_delay_ms_95"))),
        Detector("Slow Result Serialization", c("result_ser_ms_95") >= s.result_serialization_ms, _warning(), c("result_ser_ms_95") * c("num_tasks"), COMPUTE, "stability", _text("%.0f ms to serialize a result", c("result_ser_ms_95"))),
    ]


def _emit(rows: DataFrame, detectors: list[Detector]) -> DataFrame:
    """One pass: each row makes an array of the issues that hold, which is unrolled."""
    structs = [
        F.when(
            F.coalesce(d.when, F.lit(False)),
            F.struct(d.severity.alias("severity"), F.col("stage_id").cast("int").alias("stage_id"), F.lit(d.title).alias("title"), d.description.alias("description"), F.lit(d.path).alias("detail_path"), F.floor(d.savings).cast("long").alias("savings_ms"), F.lit(d.savings_type).alias("savings_type")),
        )
        for d in detectors
    ]
    return rows.select(F.explode(F.array_compact(F.array(*structs))).alias("issue")).select("issue.*")


def _average(stages: DataFrame) -> DataFrame:
    return stages.withColumn("avg_task_ms", F.when(F.col("num_complete") > 0, F.floor(F.col("run_time_ms") / F.col("num_complete"))).otherwise(F.lit(0)).cast("long"))


def failure_issues(stages: DataFrame) -> DataFrame:
    """Task failures, of any status, at the attempt with most of them; and repeated stages."""
    c, rows = F.col, _average(stages)
    worst = F.row_number().over(Window.partitionBy("stage_id").orderBy(F.desc("num_failed"), F.desc("attempt_id")))
    failed = rows.where("num_failed > 0").withColumn("_n", worst).where("_n = 1")
    failures = Detector("Task Failures", F.lit(True), F.lit("Critical"), c("num_failed") * c("avg_task_ms"), COMPUTE, "stability", _text("%.0f tasks failed", c("num_failed")))
    retried = rows.groupBy("stage_id").agg(F.count(F.lit(1)).alias("n"), F.max("num_tasks").alias("num_tasks"), F.max("avg_task_ms").alias("avg_task_ms"))
    retries = Detector("Stage Retry", c("n") > 1, F.lit("Critical"), (c("n") - 1) * c("num_tasks") * c("avg_task_ms"), COMPUTE, "stability", _text("the stage ran %.0f times", c("n")))
    return _emit(failed, [failures]).unionByName(_emit(retried, [retries]))


def application_issues(executors: DataFrame, broadcasts: DataFrame, s: IssueSettings) -> DataFrame:
    """Issues without a stage: large broadcasts, and executors whose memory use differs much."""
    none, c = F.lit(None).cast("long"), F.col
    large = Detector("Large Broadcast", c("bytes") >= s.broadcast_size_mb * MIB, _warning(), none, "", "broadcast", F.concat(c("name"), _text(" has %.1f MiB", c("bytes") / MIB)))
    heap = executors.where("is_active AND peak_jvm_heap > 0").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("peak_jvm_heap").alias("sd"), F.avg("peak_jvm_heap").alias("mean"))
    spread = _ratio(c("sd"), c("mean"))
    uneven = Detector("Executor Memory Skew", (c("n") >= s.executor_memory_min_count) & (spread >= s.executor_memory_cov), _warning(), none, "", "stability", _text("heap peaks vary by %.0f %%", spread * 100))
    no_stage = F.lit(None).cast("int").alias("stage_id")
    return _emit(broadcasts.select("*", no_stage), [large]).unionByName(_emit(heap.select("*", no_stage), [uneven]))


def stage_view(stages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Latest attempts with task quantiles: what the pages of single issues show."""
    return _average(latest_attempts(stages)).join(task_quantiles(tasks), ["stage_id", "attempt_id"], "left")


def active_cores(executors: DataFrame) -> int:
    return int(executors.where("is_active").agg(F.coalesce(F.sum("total_cores"), F.lit(0)).alias("n")).first()["n"])


def detect(stages: DataFrame, tasks: DataFrame, executors: DataFrame, broadcasts: DataFrame, settings: IssueSettings | None = None, cores: int | None = None) -> DataFrame:
    """All issues."""
    s = settings or IssueSettings()
    own = _emit(stage_view(stages, tasks), stage_detectors(s, active_cores(executors) if cores is None else cores))
    return reduce(DataFrame.unionByName, [own, failure_issues(stages), application_issues(executors, broadcasts, s)])


#: The drill-down pages: the stage columns each shows, and the order.
VIEWS = {
    "skew": (("run_time_ms_50", "run_time_ms_100"), "run_time_ms_100"),
    "gc": (("run_time_ms", "gc_time_ms"), "gc_time_ms"),
    "spill": (("mem_spill_bytes", "disk_spill_bytes", "remote_bytes_to_disk"), "disk_spill_bytes"),
    "stragglers": (("run_time_ms_50", "run_time_ms_75", "run_time_ms_100"), "run_time_ms_100"),
    "small_tasks": (("num_tasks", "run_time_ms_50", "scheduler_delay_ms_50"), "num_tasks"),
    "under_partitioned": (("num_tasks", "run_time_ms"), "num_tasks"),
    "amplification": (("input_bytes", "shuffle_write_bytes"), "shuffle_write_bytes"),
    "failures": (("num_tasks", "num_failed", "avg_task_ms"), "num_failed"),
    "speculative": (("num_tasks", "num_speculative", "avg_task_ms"), "num_speculative"),
    "large_result": (("num_tasks", "result_bytes_95"), "result_bytes_95"),
    "fetch_wait": (("run_time_ms_50", "fetch_wait_ms_50"), "fetch_wait_ms_50"),
    "deserialization": (("num_tasks", "deser_ms_95"), "deser_ms_95"),
    "low_cpu": (("run_time_ms", "cpu_time_ns"), "run_time_ms"),
    "disk_read": (("shuffle_read_bytes", "remote_bytes_to_disk"), "remote_bytes_to_disk"),
    "scheduler_delay": (("scheduler_delay_ms_50", "scheduler_delay_ms_95", "run_time_ms_50"), "scheduler_delay_ms_95"),
    "slow_serialization": (("num_tasks", "result_ser_ms_95"), "result_ser_ms_95"),
}


def view(page: str, stages: DataFrame, tasks: DataFrame) -> DataFrame:
    """A drill-down page as a table, largest first."""
    columns, by = VIEWS[page]
    return stage_view(stages, tasks).select("stage_id", "name", *columns).orderBy(F.desc(by), "stage_id")


def retries_view(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage_id").agg(F.count(F.lit(1)).alias("attempts"), F.max("num_tasks").alias("num_tasks")).where("attempts > 1").orderBy(F.desc("attempts"), "stage_id")


def broadcast_view(broadcasts: DataFrame, s: IssueSettings) -> DataFrame:
    """Broadcast tables by size, with those that are an issue."""
    return broadcasts.select("name", "bytes", F.round(F.col("bytes") / MIB, 1).alias("mib"), (F.col("bytes") >= s.broadcast_size_mb * MIB).alias("large")).orderBy(F.desc("bytes"), "name")


def executor_view(executors: DataFrame) -> DataFrame:
    """Executors by heap peak, with the band that a page colours: high from 0.9 of the most memory, raised from 0.7."""
    used = _ratio(F.col("peak_jvm_heap"), F.col("max_memory"))
    band = F.when(used >= 0.9, "high").when(used >= 0.7, "raised").otherwise("normal")
    return executors.select("*", F.round(used, 4).alias("used"), band.alias("band")).orderBy(F.desc("peak_jvm_heap"))
