"""Issues that share a cause."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cause:
    name: str
    primary: str
    secondary: tuple[str, ...]
    advice: str


#: In order of claim, the title that must occur, and those of which one must.
CAUSES = (
    Cause("Uneven Data Distribution", "Data Skew", ("Straggler Tasks", "Shuffle Spill", "Executor Memory Skew", "GC Pressure"), "Spread hot keys: salt the join, split the broadcast, or let adaptive execution split skewed partitions."),
    Cause("Memory Pressure", "GC Pressure", ("Shuffle Spill", "Large Broadcast", "Disk Shuffle Read"), "Give tasks less data (more partitions) or executors more memory; shrink broadcasts."),
    Cause("Over-partitioned Workload", "Small Tasks (Over-partitioned)", ("High Scheduler Delay",), "Use fewer partitions, or let adaptive execution coalesce them."),
    Cause("Under-parallelized Workload", "Under-partitioned Stage", ("Low CPU Utilization", "Straggler Tasks"), "Use more partitions than cores; check that inputs can be split."),
    Cause("Serialization Overhead", "High Task Deserialization", ("Large Task Result", "Slow Result Serialization"), "Broadcast large values rather than capture them; return less to the driver; use Kryo."),
    Cause("Node / Executor Instability", "Task Failures", ("Speculative Tasks", "Stage Retry"), "Look for lost executors: memory overhead, preemption, bad nodes."),
)


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def clustered(issues: DataFrame) -> DataFrame:
    """The issues with `cause` (null: none): the first cause that claims them.

    A cause holds on a stage with its primary title and one of its secondary titles; if it holds on no stage, it holds on all
    of the application if both occur anywhere. It claims the issues with its titles where it holds.
    """
    stage = F.coalesce("stage_id", F.lit(-1))
    by_stage = issues.groupBy(stage.alias("_stage")).agg(F.collect_set("title").alias("titles"))
    whole = by_stage.agg(F.flatten(F.collect_list("titles")).alias("titles")).withColumn("_stage", F.lit(None).cast("int"))
    causes = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(c.name).alias("cause"), F.lit(c.primary).alias("primary"), _array(c.secondary).alias("secondary")) for i, c in enumerate(CAUSES)])
    holds = by_stage.unionByName(whole).select("_stage", "titles", F.explode(causes).alias("c")).select("_stage", "titles", "c.*")
    holds = holds.where(F.array_contains("titles", F.col("primary")) & F.arrays_overlap("titles", "secondary"))
    # The whole application (null stage) counts only for causes that hold on no stage.
    somewhere = F.max(F.col("_stage").isNotNull()).over(Window.partitionBy("rank"))
    holds = holds.withColumn("_somewhere", somewhere).where(F.col("_stage").isNotNull() | ~F.col("_somewhere"))
    holds = holds.select("rank", "cause", "primary", "secondary", F.col("_stage").alias("at"))
    # Few rows: at most the causes times the stages on which they hold. Joined on the titles they claim.
    claims = holds.select("rank", "cause", "at", F.explode(F.array_append(F.col("secondary"), F.col("primary"))).alias("title"))
    anywhere = claims.where(F.col("at").isNull()).groupBy("title").agg(F.min(F.struct("rank", "cause")).alias("app"))
    on_stage = claims.where(F.col("at").isNotNull()).groupBy("title", F.col("at").alias("_stage")).agg(F.min(F.struct("rank", "cause")).alias("own"))
    found = issues.withColumn("_stage", stage).join(on_stage, ["title", "_stage"], "left").join(anywhere, "title", "left")
    first = F.least(F.coalesce("own", "app"), F.coalesce("app", "own"))
    return found.select(*issues.columns, first["cause"].alias("cause"))


def root_causes(issues: DataFrame) -> DataFrame:
    """name, recommendation, stages, titles, wall_ms, compute_ms (the largest saving of each kind), largest first."""
    wall = F.max(F.when(F.col("savings_type") == "Wall-clock", F.col("savings_ms")))
    other = F.max(F.when(~F.col("savings_type").isin("Wall-clock", ""), F.col("savings_ms")))
    advice = F.create_map(*[F.lit(x) for c in CAUSES for x in (c.name, c.advice)])
    out = clustered(issues).where("cause IS NOT NULL").groupBy("cause").agg(
        F.sort_array(F.collect_set("stage_id")).alias("stages"), F.sort_array(F.collect_set("title")).alias("titles"),
        F.coalesce(wall, F.lit(0)).alias("wall_ms"), F.coalesce(other, F.lit(0)).alias("compute_ms"),
    )
    return out.select(F.col("cause").alias("name"), advice[F.col("cause")].alias("recommendation"), "stages", "titles", "wall_ms", "compute_ms").orderBy(F.desc(F.col("wall_ms") + F.col("compute_ms")), "name")


def unclustered(issues: DataFrame) -> DataFrame:
    return clustered(issues).where("cause IS NULL").drop("cause")
