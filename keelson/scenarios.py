"""Workloads that provoke the issues which diagnostics find. For demonstrations; each runs an action."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _mostly(one: Column, percent: int) -> Column:
    """`one` for so many of a hundred ids, else the id."""
    return F.when(F.col("id") % 100 < percent, one).otherwise(F.col("id"))


def _sleeping(seconds: Callable[[int], float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        time.sleep(seconds(TaskContext.get().partitionId()))
        yield from batches

    return run


def _slept(spark: SparkSession, rows: int, partitions: int, seconds: Callable[[int], float]) -> int:
    return spark.range(0, rows, 1, partitions).mapInArrow(_sleeping(seconds), "id long").count()


def skew(spark: SparkSession, rows: int = 1_000_000) -> int:
    keyed = spark.range(rows).withColumn("k", _mostly(F.lit(-1), 95))
    return keyed.repartition(10, "k").groupBy("k").agg(F.sum("id")).count()


def straggler(spark: SparkSession, seconds: float = 6.0) -> int:
    return _slept(spark, 20, 20, lambda p: seconds if p < 2 else seconds / 60)


def gc(spark: SparkSession, rows: int = 2_000_000) -> int:
    text = F.col("id").cast("string")
    for _ in range(30):
        text = F.concat(text, F.lit("x"), F.col("id").cast("string"))
    return spark.range(rows).select(F.collect_list(F.substring(text, 1, 40)).alias("t")).count()


def spill(spark: SparkSession, rows: int = 1_500_000) -> int:
    wide = spark.range(rows).withColumn("t", F.rpad(F.col("id").cast("string"), 100, "x"))
    return wide.repartition(4, "id").sortWithinPartitions("t").groupBy("t").count().count()


def broadcast(spark: SparkSession, entries: int = 1_000_000) -> int:
    table = spark.range(entries).withColumn("v", F.rpad(F.col("id").cast("string"), 50, "v"))
    return spark.range(100_000).join(F.broadcast(table), "id").count()


def small_tasks(spark: SparkSession) -> int:
    return spark.range(0, 1000, 1, 500).agg(F.count(F.lit(1))).first()[0]


def failures(spark: SparkSession, failing: int = 4, partitions: int = 40) -> int:
    """Some tasks fail at their first attempt; needs spark.task.maxFailures above 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        if context.attemptNumber() == 0 and context.partitionId() < failing:
            raise RuntimeError("injected failure")
        yield from batches

    return spark.range(0, 4000, 1, partitions).mapInArrow(run, "id long").count()


def low_cpu(spark: SparkSession, seconds: float = 2.0) -> int:
    return _slept(spark, 20, 20, lambda p: seconds)


def scheduler_delay(spark: SparkSession, tasks: int = 800) -> int:
    return _slept(spark, tasks, tasks, lambda p: 0.05)


def slow_serialization(spark: SparkSession, rows: int = 20_000) -> int:
    nested = F.map_from_arrays(F.sequence(F.lit(0), F.lit(50)), F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: F.array(i, F.col("id"))))
    return len(spark.range(0, rows, 1, 20).select(nested.alias("m")).limit(rows).toPandas())


def root_cause_skew(spark: SparkSession, rows: int = 2_000_000) -> int:
    keyed = spark.range(rows).withColumn("k", _mostly(F.lit(-1), 98)).withColumn("t", F.rpad(F.col("id").cast("string"), 100, "x"))
    return keyed.repartition(10, "k").sortWithinPartitions("k", "t").groupBy("k").agg(F.max("t")).count()


def root_cause_memory(spark: SparkSession) -> int:
    return broadcast(spark) + spill(spark)


def root_cause_instability(spark: SparkSession) -> int:
    return failures(spark, 10, 40) + _slept(spark, 40, 40, lambda p: 1.0 if p % 10 == 0 else 0.01)


def slow_queries(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Queries that suggestions speak of: a CSV scan, many exchanges, a cross join, a table scanned twice."""
    spark.range(10_000).withColumn("k", F.col("id") % 50).write.mode("overwrite").csv(f"{folder}/rows", header=True)
    rows = spark.read.schema("id long, k long").csv(f"{folder}/rows", header=True)
    small = spark.range(50).withColumnRenamed("id", "k").withColumn("v", F.lit(1))
    many = rows.repartition(8, "id").join(small.hint("merge"), "k").groupBy("k").count().repartition(4, "count").orderBy("k")
    return [many, rows.crossJoin(small).limit(10), rows.join(rows.withColumnRenamed("k", "k2"), "id")]


def auto_fix(spark: SparkSession, folder: str, rows: int = 20_000_000, small: int = 3_000_000, runs: int = 4) -> list[dict]:
    """A join with nineteen rows of twenty on one key, run again and again under the tuning loop, without adaptive execution
    or broadcasts of Spark's own. A row per run: its hints and milliseconds, and the profile's status and best time."""
    from .autofix.loop import AutoFix
    from .config import AutoFixSettings
    from .plans.apply import plan_fingerprint
    from .sources.profile_store import ProfileStore

    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in fixed}
    for k, v in fixed.items():
        spark.conf.set(k, v)
    try:
        spark.range(rows).select(_mostly(F.lit(0), 95).alias("k"), F.col("id").alias("v")).createOrReplaceTempView("keelson_fact")
        spark.range(small).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("name")).createOrReplaceTempView("keelson_dim")
        query = "SELECT count(*) AS n, max(d.name) AS most FROM keelson_fact f JOIN keelson_dim d ON f.k = d.k"
        loop = AutoFix(spark, AutoFixSettings(enabled=True, mode="auto"), ProfileStore.at(spark, folder))
        out = []
        for i in range(runs):
            hints, began = loop.prepare(query)[2], time.monotonic()
            loop.run(query)
            taken = round((time.monotonic() - began) * 1000)
            profile = loop.store.load(plan_fingerprint(spark.sql(query)))
            out.append({"run": i + 1, "hints": [h.render() for h in hints], "ms": taken, "status": profile.status, "best_ms": profile.best_ms})
        return out
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


SCENARIOS: dict[str, Callable[[SparkSession], int]] = {
    "skew": skew, "straggler": straggler, "gc": gc, "spill": spill, "broadcast": broadcast, "smalltasks": small_tasks, "failures": failures, "lowcpu": low_cpu, "scheddelay": scheduler_delay,
    "slowser": slow_serialization, "rc-skew": root_cause_skew, "rc-memory": root_cause_memory, "rc-instability": root_cause_instability,
}
