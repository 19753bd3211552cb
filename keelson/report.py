"""Reports: summary tables, and a static page of them."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import config_advice, root_causes, suggestions
from .analysis.issues import detect, executor_view
from .autofix.profile import Profile
from .config import IssueSettings, SuggestionSettings
from .functions.text import format_duration
from .plans.compare import compare
from .sources.metrics import Metrics
from .sources.profile_store import ProfileStore, profiles_frame


def _saved(wall: bool) -> Column:
    """What wall-clock issues, or those of other kinds of saving, could save in all."""
    kind = F.col("savings_type") == "Wall-clock" if wall else ~F.col("savings_type").isin("Wall-clock", "")
    return F.coalesce(F.sum(F.when(kind, F.col("savings_ms"))), F.lit(0))


def _rank(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in config_advice.RANK.items() for x in pair])[severity]


def overview(issues: DataFrame) -> DataFrame:
    """One row: issues by severity, and what mending them could save."""
    return issues.agg(
        F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity") == "Critical").alias("critical"), F.count_if(F.col("severity") == "Warning").alias("warnings"),
        _saved(True).alias("wall_ms"), _saved(False).alias("other_ms"),
    )


def by_savings(issues: DataFrame) -> DataFrame:
    return issues.orderBy(F.desc_nulls_last("savings_ms"), F.desc(_rank(F.col("severity"))), "stage_id", "title")


def stages(issues: DataFrame) -> DataFrame:
    """Stages by what could be saved on them; the band is high above a minute, raised above 5 s."""
    total = F.col("wall_ms") + F.col("compute_ms")
    out = issues.where("stage_id IS NOT NULL").groupBy("stage_id").agg(F.count(F.lit(1)).alias("issues"), _saved(True).alias("wall_ms"), _saved(False).alias("compute_ms"))
    band = F.when(total > 60_000, "high").when(total > 5000, "raised").otherwise("normal")
    return out.withColumn("total_ms", total).withColumn("band", band).orderBy(F.desc("total_ms"), "stage_id")


def suggest_all(metrics: Metrics, issues: DataFrame, settings: SuggestionSettings | None = None) -> list[suggestions.Suggestion]:
    """Suggestions for every query; the plans of an application are few, and come to the driver."""
    bytes_ = {r["stage_id"]: (r["w"], r["i"]) for r in metrics.stages.groupBy("stage_id").agg(F.sum("shuffle_write_bytes").alias("w"), F.sum("input_bytes").alias("i")).collect()}
    titles: dict[int, set[str]] = {}
    for r in issues.where("stage_id IS NOT NULL").select("stage_id", "title").distinct().collect():
        titles.setdefault(r["stage_id"], set()).add(r["title"])
    partitions = int(metrics.properties.get("spark.sql.shuffle.partitions", 200))
    out = []
    for e in metrics.executions.orderBy(F.desc("execution_id")).collect():
        ids = frozenset(e["stage_ids"] or ())
        if not ids:
            continue
        run = suggestions.Execution(e["execution_id"], e["plan"], ids, {i: bytes_[i][0] for i in ids if i in bytes_}, {i: bytes_[i][1] for i in ids if i in bytes_}, frozenset(t for i in ids for t in titles.get(i, ())))
        out += suggestions.suggest(run, partitions, settings)
    return out


def configuration(spark: SparkSession, metrics: Metrics, issues: DataFrame) -> DataFrame:
    spilled = metrics.stages.agg(F.coalesce(F.sum("disk_spill_bytes"), F.lit(0)).alias("n")).first()["n"]
    rows = [r.asDict() for r in issues.select("severity", "title", "savings_ms").collect()]
    return config_advice.recommendations_frame(spark, config_advice.advise(rows, metrics.properties, spilled))


def report(spark: SparkSession, metrics: Metrics, store: ProfileStore | None = None, settings: IssueSettings | None = None) -> dict[str, DataFrame]:
    """All tables of the report by title, in order."""
    issues = detect(metrics.stages, metrics.tasks, metrics.executors, metrics.broadcasts, settings).cache()
    out = {
        "Overview": overview(issues),
        "Issues": by_savings(issues),
        "Root causes": root_causes.root_causes(issues),
        "Other issues": root_causes.unclustered(issues),
        "Stages": stages(issues),
        "Suggestions": suggestions.suggestions_frame(spark, suggest_all(metrics, issues)),
        "Configuration": configuration(spark, metrics, issues),
        "Executors": executor_view(metrics.executors),
    }
    if store is not None:
        out["Tuning"] = profiles_frame(spark, store)
    return out


def _cells(values: Sequence, tag: str) -> str:
    return "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values)


def to_html(tables: dict[str, DataFrame], profiles: Sequence[Profile] = (), rows: int = 200) -> str:
    """A static page; each table shows its first rows."""
    parts = ["<!DOCTYPE html><meta charset=utf-8><title>Spark report</title><style>body{font:14px sans-serif}td,th{padding:2px 8px;text-align:left}pre{margin:0}</style>"]
    for title, df in tables.items():
        body = "".join(f"<tr>{_cells(r, 'td')}</tr>" for r in df.limit(rows).collect())
        parts.append(f"<h2>{html.escape(title)}</h2><table><tr>{_cells(df.columns, 'th')}</tr>{body}</table>")
    for p in profiles:
        best = "" if p.best_ms is None else format_duration(p.best_ms)
        parts.append(f"<h3>Plan of {html.escape(p.fingerprint)} (best {best})</h3>{plan_html(p.baseline_plan or '', p.current_plan or '')}")
    return "\n".join(parts)


def plan_html(before: str, after: str) -> str:
    rows = compare(before, after)
    if rows is None:
        return f"<pre>{html.escape(before)}</pre><hr><pre>{html.escape(after)}</pre>"
    return "<table>" + "".join(f"<tr>{_cells(r, 'td')}</tr>" for r in rows) + "</table>"
