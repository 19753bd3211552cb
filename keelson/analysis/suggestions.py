"""Suggestions for queries, from their plans and the metrics of their stages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..config import MIB, SuggestionSettings
from ..functions.text import format_bytes
from ..plans.parser import ParsedPlan, parse_plan

SUGGESTIONS = "severity string, execution_id long, title string, description string, recommendation string, savings_ms long, savings_type string"
#: What a partition should hold, bytes shuffled a second, and titles that adaptive execution would mend.
TARGET_PARTITION, SHUFFLE_SPEED = 128 * MIB, 100 * MIB
ADAPTIVE_MENDS = {"Data Skew", "Small Tasks (Over-partitioned)", "Under-partitioned Stage"}
SLOW_FORMATS = ("csv", "json", "text")


@dataclass(frozen=True)
class Execution:
    """A query: its plan, its stages, their shuffle writes and input bytes, and titles of the issues found on them."""

    id: int | None
    plan: str
    stage_ids: frozenset[int] = frozenset()
    shuffle_write: Mapping[int, int] | None = None
    input_bytes: Mapping[int, int] | None = None
    issue_titles: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Suggestion:
    severity: str
    execution_id: int | None
    title: str
    description: str
    recommendation: str
    savings_ms: int | None = None
    savings_type: str = ""


def suggest(run: Execution, shuffle_partitions: int, s: SuggestionSettings | None = None) -> list[Suggestion]:
    s, plan = s or SuggestionSettings(), parse_plan(run.plan)
    of = lambda m: [v for k, v in (m or {}).items() if not run.stage_ids or k in run.stage_ids]
    writes, inputs = of(run.shuffle_write), of(run.input_bytes)
    return [x for rule in RULES for x in rule(run, plan, writes, inputs, shuffle_partitions, s)]


def _broadcast(run, plan: ParsedPlan, writes, inputs, partitions, s) -> Iterable[Suggestion]:
    smallest = min((w for w in writes if w > 0), default=0)
    if plan.joins and 0 < smallest <= s.broadcast_threshold_bytes:
        severity = "Critical" if smallest < 10 * MIB else "Warning"
        yield Suggestion(severity, run.id, "Broadcast Join Candidate", f"{plan.joins[0]} shuffles a side of {format_bytes(smallest)}", "Broadcast that side: F.broadcast(df), or raise spark.sql.autoBroadcastJoinThreshold.")


def _shuffles(run, plan, writes, inputs, partitions, s):
    if plan.exchanges > s.excessive_shuffle_count:
        yield Suggestion("Warning", run.id, "Excessive Shuffles", f"{plan.exchanges} exchanges", "Reuse a partitioning across joins and aggregations; bucket tables that are often joined.", sum(writes) // SHUFFLE_SPEED * 1000, "I/O")


def _adaptive(run, plan, writes, inputs, partitions, s):
    if not plan.adaptive and plan.exchanges > 0:
        severity = "Warning" if run.issue_titles & ADAPTIVE_MENDS else "Info"
        yield Suggestion(severity, run.id, "AQE Not Enabled", "the plan is not adaptive", "Set spark.sql.adaptive.enabled to true.")


def _cartesian(run, plan, writes, inputs, partitions, s):
    for node in plan.cartesians:
        yield Suggestion("Critical", run.id, "Cartesian Product", f"{node} pairs every row with every row", "Add an equality to the join's condition.")


def _format(run, plan, writes, inputs, partitions, s):
    for f in dict.fromkeys(x.format for x in plan.scans if x.format in SLOW_FORMATS):
        yield Suggestion("Info", run.id, "Suboptimal File Format", f"reads {f}", "Store the table as Parquet: columns and filters are then pruned at the scan.")


def _pruning(run, plan, writes, inputs, partitions, s):
    if inputs and sum(inputs) < s.partition_prune_scan_min_mb * MIB:
        return
    for x in plan.scans:
        if not x.partition_filters and (x.pushed_filters or x.data_filters):
            yield Suggestion("Warning", run.id, "Missing Partition Pruning", f"a {x.format} scan filters rows but no partitions", "Partition the table by a filtered column, or filter by its partition column.")


def _python(run, plan, writes, inputs, partitions, s):
    for node, n in Counter(plan.python).items():
        yield Suggestion("Warning", run.id, "Python UDF Detected", f"{n} × {node}", "Use built-in functions, or Pandas UDFs where none fits.")


def _repeated(run, plan, writes, inputs, partitions, s):
    for (f, where), n in Counter((x.format, x.location) for x in plan.scans).items():
        if n >= 2:
            yield Suggestion("Warning", run.id, "Repeated Table Scan", f"{n} scans of {where or f}", "Cache the table, or share the scan.")


def _collect(run, plan, writes, inputs, partitions, s):
    total = sum(inputs)
    if plan.limits and total >= s.collect_large_data_min_mb * MIB:
        yield Suggestion("Critical" if total > 1024 * MIB else "Warning", run.id, "Collect on Large Dataset", f"{format_bytes(total)} read for rows sent to the driver", "Write the result, or aggregate before collecting.")


def _partitions(run, plan, writes, inputs, partitions, s):
    total = sum(writes)
    if plan.exchanges > 0 and not plan.adaptive and total > 0:
        wanted = max(1, total // TARGET_PARTITION)
        if partitions / wanted >= 3 or partitions / wanted <= 0.33:
            yield Suggestion("Warning", run.id, "Shuffle Partition Tuning", f"{partitions} partitions for {format_bytes(total)}", f"Set spark.sql.shuffle.partitions to {wanted}.")


RULES = (_broadcast, _shuffles, _adaptive, _cartesian, _format, _pruning, _python, _repeated, _collect, _partitions)


def suggest_rows(executions: DataFrame, shuffle_partitions: int, settings: SuggestionSettings | None = None) -> DataFrame:
    """Suggestions for many queries. executions: execution_id, plan, shuffle_write and input_bytes (arrays, by stage), issue_titles."""

    def run(frames):
        for frame in frames:
            out = []
            for x in frame.itertuples(index=False):
                whole = lambda values: dict(enumerate(map(int, values if values is not None else ())))
                titles = frozenset(x.issue_titles if x.issue_titles is not None else ())
                found = suggest(Execution(x.execution_id, x.plan, frozenset(), whole(x.shuffle_write), whole(x.input_bytes), titles), shuffle_partitions, settings)
                out += [(f.severity, f.execution_id, f.title, f.description, f.recommendation, f.savings_ms, f.savings_type) for f in found]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SUGGESTIONS.split(", ")]).astype({"savings_ms": "Int64"})

    columns = ("execution_id", "plan", "shuffle_write", "input_bytes", "issue_titles")
    return executions.select(*columns).mapInPandas(run, SUGGESTIONS)


def suggestions_frame(spark: SparkSession, found: Sequence[Suggestion]) -> DataFrame:
    return spark.createDataFrame([(x.severity, x.execution_id, x.title, x.description, x.recommendation, x.savings_ms, x.savings_type) for x in found], SUGGESTIONS)
