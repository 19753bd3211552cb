"""Run-time metrics as tables: from an event log, or from the live session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..analysis.issues import BROADCASTS, EXECUTORS, STAGES, TASKS
from ..plans import internals as I

EXECUTIONS = "execution_id long, plan string, stage_ids array<int>"
JOBS = "job_id int, stage_id int, execution_id long"
RDDS = "rdd_id int, name string, memory_bytes long, disk_bytes long"


@dataclass(frozen=True)
class Metrics:
    """The tables that detectors read, the queries with their plans, and which job and query each stage belongs to."""

    stages: DataFrame
    tasks: DataFrame
    executors: DataFrame
    broadcasts: DataFrame
    executions: DataFrame
    jobs: DataFrame
    properties: dict[str, str]


#: The parts of event-log lines that are read; given as a schema, nothing is inferred and other events stay unparsed.
EVENT = """
`Event` string, `Stage ID` int, `Stage Attempt ID` int, `Job ID` int, `Executor ID` string, `executionId` long, `physicalPlanDescription` string, `Stage IDs` array<int>,
`Stage Info` struct<`Stage ID`: int, `Stage Attempt ID`: int, `Stage Name`: string, `Number of Tasks`: int, `Completion Time`: long, `Failure Reason`: string>,
`Task Info` struct<`Task ID`: long, `Launch Time`: long, `Finish Time`: long, `Failed`: boolean, `Killed`: boolean, `Speculative`: boolean, `Getting Result Time`: long>,
`Task Metrics` struct<`Executor Deserialize Time`: long, `Executor Run Time`: long, `Executor CPU Time`: long, `Result Size`: long, `JVM GC Time`: long, `Result Serialization Time`: long,
 `Memory Bytes Spilled`: long, `Disk Bytes Spilled`: long, `Input Metrics`: struct<`Bytes Read`: long>,
 `Shuffle Read Metrics`: struct<`Fetch Wait Time`: long, `Remote Bytes Read`: long, `Local Bytes Read`: long, `Remote Bytes Read To Disk`: long>,
 `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: long>>,
`Task Executor Metrics` struct<`JVMHeapMemory`: long>, `Executor Metrics Updated` array<struct<`Executor Metrics`: struct<`JVMHeapMemory`: long>>>,
`Executor Info` struct<`Total Cores`: int>, `Block Manager ID` struct<`Executor ID`: string>, `Maximum Memory` long, `Spark Properties` map<string, string>, `Properties` map<string, string>,
`sparkPlanInfo` string, `accumUpdates` array<array<long>>
"""


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def from_event_log(spark: SparkSession, path: str) -> Metrics:
    """From event-log files (a file, a folder, or a pattern), read in parallel by Spark."""
    events = spark.read.schema(EVENT).json(path).withColumn("kind", F.element_at(F.split("Event", r"\."), -1))
    of = lambda kind: events.where(F.col("kind") == kind)
    m = lambda name: f"`Task Metrics`.{name}"
    ended = of("SparkListenerTaskEnd")
    task = ended.select(
        F.col("`Stage ID`").alias("stage_id"), F.col("`Stage Attempt ID`").alias("attempt_id"), F.col("`Task Info`.`Task ID`").alias("task_id"), F.col("`Executor ID`").alias("on"),
        (F.col("`Task Info`.Failed") | F.col("`Task Info`.Killed")).alias("failed"), F.col("`Task Info`.Failed").alias("broke"), F.col("`Task Info`.Speculative").alias("speculative"),
        (F.col("`Task Info`.`Finish Time`") - F.col("`Task Info`.`Launch Time`")).alias("wall"),
        F.col(m("`Executor Run Time`")).alias("run"), F.col(m("`Executor CPU Time`")).alias("cpu"), F.col(m("`JVM GC Time`")).alias("gc"), F.col(m("`Executor Deserialize Time`")).alias("deser"),
        F.col(m("`Result Serialization Time`")).alias("ser"), F.col(m("`Result Size`")).alias("result"), F.col(m("`Input Metrics`.`Bytes Read`")).alias("input"),
        F.col(m("`Shuffle Read Metrics`.`Fetch Wait Time`")).alias("fetch"), (F.col(m("`Shuffle Read Metrics`.`Remote Bytes Read`")) + F.col(m("`Shuffle Read Metrics`.`Local Bytes Read`"))).alias("read"),
        F.col(m("`Shuffle Read Metrics`.`Remote Bytes Read To Disk`")).alias("to_disk"), F.col(m("`Shuffle Write Metrics`.`Shuffle Bytes Written`")).alias("written"),
        F.col(m("`Memory Bytes Spilled`")).alias("mem_spill"), F.col(m("`Disk Bytes Spilled`")).alias("disk_spill"), F.col("`Task Executor Metrics`.JVMHeapMemory").alias("heap"),
    )
    sums = task.groupBy("stage_id", "attempt_id").agg(
        F.count_if(~F.col("failed")).alias("num_complete"), F.count_if("broke").alias("num_failed"), F.count_if("speculative").alias("num_speculative"), _sum("run").alias("run_time_ms"),
        _sum("cpu").alias("cpu_time_ns"), _sum("gc").alias("gc_time_ms"), _sum("input").alias("input_bytes"), _sum("read").alias("shuffle_read_bytes"), _sum("written").alias("shuffle_write_bytes"),
        _sum("to_disk").alias("remote_bytes_to_disk"), _sum("mem_spill").alias("mem_spill_bytes"), _sum("disk_spill").alias("disk_spill_bytes"),
    )
    info = lambda kind: of(kind).select(F.col("`Stage Info`.`Stage ID`").alias("stage_id"), F.col("`Stage Info`.`Stage Attempt ID`").alias("attempt_id"), F.col("`Stage Info`.`Stage Name`").alias("name"), F.col("`Stage Info`.`Number of Tasks`").alias("num_tasks"), F.col("`Stage Info`.`Completion Time`").alias("done"), F.col("`Stage Info`.`Failure Reason`").alias("why"))
    known = info("SparkListenerStageSubmitted").unionByName(info("SparkListenerStageCompleted")).groupBy("stage_id", "attempt_id").agg(F.max("name").alias("name"), F.max("num_tasks").alias("num_tasks"), F.max("done").alias("done"), F.max("why").alias("why"))
    status = F.when(F.col("why").isNotNull(), "FAILED").when(F.col("done").isNotNull(), "COMPLETE").otherwise("ACTIVE")
    stages = _like(known.withColumn("status", status).join(sums, ["stage_id", "attempt_id"], "left"), STAGES)
    delay = F.greatest(F.lit(0), F.col("wall") - F.col("run") - F.col("deser") - F.col("ser"))
    ok = task.where("NOT failed AND run IS NOT NULL")
    tasks = _like(ok.select("stage_id", "attempt_id", "task_id", F.col("run").alias("run_time_ms"), delay.alias("scheduler_delay_ms"), F.col("deser").alias("deser_ms"), F.col("ser").alias("result_ser_ms"), F.col("result").alias("result_bytes"), F.col("fetch").alias("fetch_wait_ms")), TASKS)
    added = of("SparkListenerExecutorAdded").select(F.col("`Executor ID`").alias("executor_id"), F.col("`Executor Info`.`Total Cores`").alias("total_cores"))
    removed = of("SparkListenerExecutorRemoved").select(F.col("`Executor ID`").alias("executor_id"), F.lit(False).alias("is_active"))
    memory = of("SparkListenerBlockManagerAdded").groupBy(F.col("`Block Manager ID`.`Executor ID`").alias("executor_id")).agg(F.max("`Maximum Memory`").alias("max_memory"))
    heap = task.groupBy(F.col("on").alias("executor_id")).agg(F.max("heap").alias("peak_jvm_heap"))
    executors = added.join(removed, "executor_id", "left").join(memory, "executor_id", "left").join(heap, "executor_id", "left").withColumn("is_active", F.coalesce("is_active", F.lit(True)))
    # Exchanges have a metric "data size"; only broadcasts update it from the driver.
    metric = r'"name":\s*"data size",\s*"accumulatorId":\s*(\d+)'
    planned = events.where("sparkPlanInfo IS NOT NULL").select(F.explode(F.regexp_extract_all("sparkPlanInfo", F.lit(metric), 1)).alias("id")).select(F.col("id").cast("long")).distinct()
    updates = of("SparkListenerDriverAccumUpdates").select(F.explode("accumUpdates").alias("u")).select(F.col("u")[0].alias("id"), F.col("u")[1].alias("bytes"))
    broadcasts = updates.join(planned, "id", "left_semi").groupBy(F.concat(F.lit("broadcast_"), F.col("id")).alias("name")).agg(F.max("bytes").alias("bytes"))
    jobs = of("SparkListenerJobStart").select(F.col("`Job ID`").alias("job_id"), F.explode_outer("`Stage IDs`").alias("stage_id"), F.col("Properties")["spark.sql.execution.id"].try_cast("long").alias("execution_id"))
    plans = events.where("physicalPlanDescription IS NOT NULL").withColumn("at", F.monotonically_increasing_id()).groupBy(F.col("executionId").alias("execution_id")).agg(F.max_by("physicalPlanDescription", "at").alias("plan"))
    executions = plans.join(jobs.groupBy("execution_id").agg(F.sort_array(F.collect_set("stage_id")).alias("stage_ids")), "execution_id", "left")
    first = of("SparkListenerEnvironmentUpdate").select("`Spark Properties`").first()
    return Metrics(stages, tasks, _like(executors, EXECUTORS), _like(broadcasts, BROADCASTS), _like(executions, EXECUTIONS), _like(jobs, JOBS), dict(first[0] or {}) if first else {})


def _like(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema, cast."""
    return df.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in ddl.split(", ")])


def _option(value, default=0):
    return value.get() if value.isDefined() else default


def from_session(spark: SparkSession) -> Metrics:
    """From the status store of the running application: as many rows as Spark keeps there."""
    store, none = I.status_store(spark), I.java_list(spark)
    stages, tasks = [], []
    for s in I.scala_list(store.stageList(none, False, False, I.doubles(spark, []), none)):
        speculative = s.speculationSummary()
        stages.append((s.stageId(), s.attemptId(), s.name(), s.status().toString(), s.numTasks(), s.numCompleteTasks(), s.numFailedTasks(), speculative.get().numTasks() if speculative.isDefined() else 0, s.executorRunTime(), s.executorCpuTime(), s.jvmGcTime(), s.inputBytes(), s.shuffleReadBytes(), s.shuffleWriteBytes(), s.shuffleRemoteBytesReadToDisk(), s.memoryBytesSpilled(), s.diskBytesSpilled()))
        for t in I.scala_list(store.taskList(s.stageId(), s.attemptId(), (1 << 31) - 1)):
            if t.status() == "SUCCESS" and t.taskMetrics().isDefined():
                m = t.taskMetrics().get()
                tasks.append((s.stageId(), s.attemptId(), t.taskId(), float(m.executorRunTime()), float(t.schedulerDelay()), float(m.executorDeserializeTime()), float(m.resultSerializationTime()), float(m.resultSize()), float(m.shuffleReadMetrics().fetchWaitTime())))
    executors = []
    for e in I.scala_list(store.executorList(False)):
        peak = e.peakMemoryMetrics()
        executors.append((e.id(), e.isActive(), e.totalCores(), peak.get().getMetricValue("JVMHeapMemory") if peak.isDefined() else 0, e.maxMemory()))
    executions, jobs, broadcasts = [], [], {}
    sql = I.sql_store(spark)
    for x in I.scala_list(sql.executionsList()):
        ids = sorted(int(i) for i in I.scala_list(x.stages().toSeq()))
        executions.append((x.executionId(), x.physicalPlanDescription(), ids))
        for job in I.scala_list(x.jobs().keys().toSeq()):
            jobs += [(int(job), i, x.executionId()) for i in ids]
        values = sql.executionMetrics(x.executionId())
        for node in I.scala_list(sql.planGraph(x.executionId()).allNodes()):
            for metric in I.scala_list(node.metrics()) if node.name() == "BroadcastExchange" else []:
                if metric.name() == "data size" and values.contains(metric.accumulatorId()):
                    broadcasts[f"broadcast_{metric.accumulatorId()}"] = parse_size(values.apply(metric.accumulatorId()))
    frame = spark.createDataFrame
    return Metrics(frame(stages, STAGES), frame(tasks, TASKS), frame(executors, EXECUTORS), frame(list(broadcasts.items()), BROADCASTS), frame(executions, EXECUTIONS), frame(jobs, JOBS), dict(spark.sparkContext.getConf().getAll()))


def parse_size(text: str) -> int:
    """Bytes from a metric's text, such as `4.0 MiB` (the total, where it also has minimum and maximum)."""
    last = text.strip().splitlines()[-1].split("(")[0].split()
    units = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40}
    return int(float(last[0].replace(",", "")) * units.get(last[1], 1)) if len(last) >= 2 else 0
