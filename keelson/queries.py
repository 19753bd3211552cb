"""Queries over the driver's tables, one or more per operator, and the same as SQL.

Skewed keys are derived, as the tables' own are near uniform: HOT sends nine tenths of lineitem to one supplier. Diagnostics
read lineitem and orders as if they were tables of task and stage metrics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import issues as I
from .analysis import root_causes as R
from . import report
from .config import IssueSettings, ResilientSettings
from .operators.diff import DiffConfig, DiffResult, diff
from .operators.joins import AutoSaltConfig, BroadcastStrategy, JoinConfig, RepartitionStrategy, ShuffledHashStrategy, SortMergeStrategy, SplitBroadcastConfig, auto_salt_join, hot_keys, resilient_join, salted_join, split_broadcast_join, split_join
from .operators.joins.resilient import engine_join
from .plans.apply import apply_hints, hinted_sql
from .plans.hints import Broadcast, Coalesce, Rebalance, Repartition

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- Diff: orders against a changed copy ----------------------------------------------------------------------------------

MUTATED = """(SELECT CASE WHEN o_orderkey % 50 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 20 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate,
    CASE WHEN o_orderkey % 60 = 1 THEN 'x' ELSE o_orderpriority END AS o_orderpriority FROM orders 
  UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 40 = 3)"""
DIFFERS = "(l.o_totalprice IS DISTINCT FROM r.o_totalprice OR l.o_orderpriority IS DISTINCT FROM r.o_orderpriority OR l.o_custkey IS DISTINCT FROM r.o_custkey OR l.o_orderstatus IS DISTINCT FROM r.o_orderstatus OR l.o_orderdate IS DISTINCT FROM r.o_orderdate)"
ADDED = f"SELECT r.* FROM {MUTATED} r ANTI JOIN orders l ON l.o_orderkey = r.o_orderkey"
REMOVED = f"SELECT l.* FROM orders l ANTI JOIN {MUTATED} r ON l.o_orderkey = r.o_orderkey"
CHANGED = f"""SELECT l.o_orderkey, l.o_totalprice AS left_o_totalprice, r.o_totalprice AS right_o_totalprice, l.o_orderpriority AS left_o_orderpriority, r.o_orderpriority AS right_o_orderpriority,
    concat_ws(',', CASE WHEN l.o_totalprice IS DISTINCT FROM r.o_totalprice THEN 'o_totalprice' END, CASE WHEN l.o_orderpriority IS DISTINCT FROM r.o_orderpriority THEN 'o_orderpriority' END) AS changed
  FROM orders l JOIN {MUTATED} r ON l.o_orderkey = r.o_orderkey WHERE {DIFFERS}"""
SUMMARY = f"SELECT (SELECT count(*) FROM ({ADDED})) AS added, (SELECT count(*) FROM ({REMOVED})) AS removed, (SELECT count(*) FROM ({CHANGED})) AS changed"


def mutated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    changed = o.withColumns({"o_orderkey": F.when(k % 50 == 0, -k - 1).otherwise(k), "o_totalprice": F.when(k % 20 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderpriority": F.when(k % 60 == 1, F.lit("x")).otherwise(F.col("o_orderpriority"))})
    return o, changed.unionByName(o.where(k % 40 == 3).withColumn("o_orderkey", k + 10_000_000))


def orders_diff(spark: SparkSession, d: str, strategy: str = "full") -> DiffResult:
    left, right = mutated(spark, d)
    return diff(left, right, DiffConfig(["o_orderkey"], limit=None), strategy)


def _changed(result: DiffResult) -> DataFrame:
    return result.changed.select("o_orderkey", "left_o_totalprice", "right_o_totalprice", "left_o_orderpriority", "right_o_orderpriority", F.array_join("changed_columns", ",").alias("changed"))


for _strategy in ("full", "hash", "bloom"):
    _suffix = "" if _strategy == "full" else f"_{_strategy}"
    query(ADDED, f"diff_added{_suffix}")(lambda s, d, x=_strategy: orders_diff(s, d, x).added)
    query(REMOVED, f"diff_removed{_suffix}")(lambda s, d, x=_strategy: orders_diff(s, d, x).removed)
    query(CHANGED, f"diff_changed{_suffix}")(lambda s, d, x=_strategy: _changed(orders_diff(s, d, x)))
    query(SUMMARY, f"diff_summary{_suffix}")(lambda s, d, x=_strategy: orders_diff(s, d, x).counts)


@query(f"SELECT l.o_orderkey, l.o_orderpriority AS left_o_orderpriority, r.o_orderpriority AS right_o_orderpriority FROM orders l JOIN {MUTATED} r ON l.o_orderkey = r.o_orderkey WHERE l.o_orderpriority IS DISTINCT FROM r.o_orderpriority")
def diff_explicit_columns(spark: SparkSession, d: str) -> DataFrame:
    left, right = mutated(spark, d)
    return diff(left, right, DiffConfig(["o_orderkey"], ["o_orderpriority"], None), "hash").changed.drop("changed_columns")


@query(f"SELECT r.* FROM {MUTATED} r ANTI JOIN orders l ON l.o_orderkey = r.o_orderkey ORDER BY r.o_orderkey LIMIT 100")
def diff_limited(spark: SparkSession, d: str) -> DataFrame:
    """The limit is part of the operator: the first rows by key."""
    left, right = mutated(spark, d)
    return diff(left, right, DiffConfig(["o_orderkey"])).added


@query("""WITH a AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_partkey, l_suppkey, count(CASE WHEN l_orderkey % 7 <> 0 THEN 1 END) AS n FROM lineitem GROUP BY ALL)
    SELECT a.l_partkey, a.l_suppkey, a.n AS left_n, b.n AS right_n FROM a JOIN b USING (l_partkey, l_suppkey) WHERE a.n <> b.n""")
def diff_composite_key(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem")
    count = lambda c: li.groupBy("l_partkey", "l_suppkey").agg(F.count(c).alias("n"))
    return diff(count(F.lit(1)), count(F.when(F.col("l_orderkey") % 7 != 0, 1)), DiffConfig(["l_partkey", "l_suppkey"], limit=None)).changed.drop("changed_columns")


@query("""WITH a AS (SELECT nullif(c_nationkey, 3) AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT nullif(c_nationkey, 3) AS k, count(CASE WHEN c_custkey % 10 <> 0 THEN 1 END) AS n FROM customer GROUP BY 1)
    SELECT a.k, a.n AS left_n, b.n AS right_n FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k WHERE a.n <> b.n""")
def diff_null_keys(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").withColumn("k", F.expr("nullif(c_nationkey, 3)"))
    count = lambda one: c.groupBy("k").agg(F.count(one).alias("n"))
    return diff(count(F.lit(1)), count(F.when(F.col("c_custkey") % 10 != 0, 1)), DiffConfig(["k"], limit=None), "hash").changed.drop("changed_columns")


@query("SELECT event_id FROM events WHERE event_id % 11 = 0")
def diff_timestamp_micros(spark: SparkSession, d: str) -> DataFrame:
    """A change of one microsecond is a change, for the hash as well."""
    e = t(spark, d, "events").select("event_id", "ts", "user_id")
    later = e.withColumn("ts", F.when(F.col("event_id") % 11 == 0, F.col("ts") + F.expr("INTERVAL '0.000001' SECOND")).otherwise(F.col("ts")))
    return diff(e, later, DiffConfig(["event_id"], limit=None), "hash").changed.select("event_id")


# -- Joins ----------------------------------------------------------------------------------------------------------------

HOW = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN", "left_semi": "SEMI JOIN", "left_anti": "ANTI JOIN"}


#: Every row takes part; some get a key that the other side lacks.
LEFT_KEY, RIGHT_KEY = "CASE WHEN o_orderkey % 3 = 0 THEN -o_custkey ELSE o_custkey END", "CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 100000000 ELSE c_custkey END"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.expr(LEFT_KEY).alias("k"))
    return o, t(spark, d, "customer").select(F.expr(RIGHT_KEY).alias("k"), "c_name")


def _joined(how: str) -> str:
    left, right = f"(SELECT o_orderkey, o_totalprice, {LEFT_KEY} AS k FROM orders)", f"(SELECT {RIGHT_KEY} AS k, c_name FROM customer)"
    if how in ("left_semi", "left_anti"):
        return f"SELECT k, o_orderkey, o_totalprice FROM {left} l {HOW[how]} {right} r USING (k)"
    return f"SELECT k, o_orderkey, o_totalprice, c_name FROM {left} l {HOW[how]} {right} r USING (k)"


_PLAIN = JoinConfig(cache=False)
for _how in HOW:
    query(_joined(_how), f"join_resilient_{_how}")(lambda s, d, h=_how: resilient_join(*_sides(s, d), ["k"], h, _PLAIN))
    query(_joined(_how), f"join_engine_{_how}")(lambda s, d, h=_how: engine_join(*_sides(s, d), ["k"], h, ResilientSettings(enabled=True)).result)
for _strategy in (BroadcastStrategy(), ShuffledHashStrategy(), SortMergeStrategy(), RepartitionStrategy(16)):
    query(_joined("inner"), f"join_{_strategy.name}")(lambda s, d, x=_strategy: x.join(*_sides(s, d), ["k"], "inner", None))


class _Failing:
    name = "failing"

    def can_handle(self, left, right, how, previous) -> bool:
        return True

    def join(self, left, right, keys, how, previous):
        raise MemoryError("injected failure")


@query(_joined("inner"))
def join_resilient_fallback(spark: SparkSession, d: str) -> DataFrame:
    return resilient_join(*_sides(spark, d), ["k"], "inner", JoinConfig([_Failing(), SortMergeStrategy()], cache=False))


LINES_PARTS = "SELECT l_orderkey, l_linenumber, l_quantity, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_partkey").alias("k"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_size")


for _n in (2, 4, 8):
    query(LINES_PARTS, f"split_broadcast_inner_{_n}")(lambda s, d, n=_n: split_join(_lines(s, d), _parts(s, d), ["k"], "inner", n).drop("k"))


@query(LINES_PARTS)
def split_broadcast_escalating(spark: SparkSession, d: str) -> DataFrame:
    return split_broadcast_join(_lines(spark, d), _parts(spark, d), ["k"], "inner", SplitBroadcastConfig(budget_bytes=16 << 20, cache_result=False, cache_large_side=False, initial=None)).drop("k")


SMALL_PART = "CASE WHEN p_size < 10 THEN p_partkey ELSE -p_partkey END"


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem SEMI JOIN (SELECT {SMALL_PART} AS k FROM part) p ON l_partkey = p.k")
def split_broadcast_semi(spark: SparkSession, d: str) -> DataFrame:
    return split_join(_lines(spark, d), t(spark, d, "part").select(F.expr(SMALL_PART).alias("k")), ["k"], "left_semi", 4).drop("k")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def split_broadcast_cross(spark: SparkSession, d: str) -> DataFrame:
    return split_join(t(spark, d, "nation").select("n_name"), t(spark, d, "region").select("r_name"), [], "cross", 2)


PAIRS = "(SELECT l_partkey, l_suppkey, {} AS n FROM lineitem GROUP BY ALL)"


@query(f"SELECT l_partkey, l_suppkey, a.n AS n_lines, b.n AS most FROM {PAIRS.format('count(*)')} a JOIN {PAIRS.format('max(l_quantity)')} b USING (l_partkey, l_suppkey)")
def split_broadcast_multikey(spark: SparkSession, d: str) -> DataFrame:
    of = lambda c: t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(c)
    return split_join(of(F.count(F.lit(1)).alias("n_lines")), of(F.max("l_quantity").alias("most")), ["l_partkey", "l_suppkey"], "inner", 4)


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def split_broadcast_duplicates(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    return split_join(t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), s, ["k"], "inner", 3).drop("k")


HOT = "CASE WHEN l_orderkey % 10 <> 0 THEN 1 ELSE l_suppkey END"
HOT_LINES = f"(SELECT l_orderkey, l_linenumber, {HOT} AS k FROM lineitem)"


def _hot_lines(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(HOT).alias("k"))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")


#: A fifth of the suppliers get a key that no line has.
SUPPLIER_KEY = "CASE WHEN s_suppkey % 5 = 3 THEN -s_suppkey ELSE s_suppkey END"


def _some_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").select(F.expr(SUPPLIER_KEY).alias("k"), "s_name")


@query(f"SELECT k FROM {HOT_LINES} GROUP BY k HAVING count(*) >= (SELECT greatest(10 * quantile_disc(freq, 0.5), 100) FROM (SELECT count(*) AS freq FROM {HOT_LINES} GROUP BY k))")
def hot_keys_by_sample(spark: SparkSession, d: str) -> DataFrame:
    """Found on half of the rows; nine tenths of all have the hot key, so any such sample finds it and no other."""
    return hot_keys(_hot_lines(spark, d), ["k"], sample_fraction=0.5).select("k")


@query(f"WITH c AS (SELECT k, count(*) AS freq FROM {HOT_LINES} GROUP BY k) SELECT k, freq FROM c WHERE freq >= (SELECT greatest(10 * quantile_disc(freq, 0.5), 100) FROM c)", "hot_keys")
def _hot_keys(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys(_hot_lines(spark, d), ["k"], sample_fraction=1.0)


_AUTO = AutoSaltConfig(sample_fraction=1.0, cache_result=False)
for _how, _side in (("inner", "l"), ("left", "l"), ("right", "r")):
    _sql = f"SELECT k, l_orderkey, l_linenumber, s_name FROM {HOT_LINES} l {HOW[_how]} (SELECT {SUPPLIER_KEY} AS k, s_name FROM supplier) s USING (k)"
    query(_sql, f"salt_{_how}")(lambda s, d, h=_how: auto_salt_join(_hot_lines(s, d), _some_suppliers(s, d), ["k"], h, _AUTO))


@query(f"SELECT k, l_orderkey, l_linenumber, s_name FROM (SELECT {SUPPLIER_KEY} AS k, s_name FROM supplier) s RIGHT JOIN {HOT_LINES} l USING (k)")
def salt_right_preserved(spark: SparkSession, d: str) -> DataFrame:
    return auto_salt_join(_some_suppliers(spark, d), _hot_lines(spark, d), ["k"], "right", _AUTO)


@query(f"SELECT k, l_orderkey, l_linenumber, s_name FROM {HOT_LINES} l JOIN (SELECT s_suppkey AS k, s_name FROM supplier) s USING (k)")
def salt_uniform(spark: SparkSession, d: str) -> DataFrame:
    # By a sort-merge join, as of two large sides, so that the salted shuffle is what runs.
    return salted_join(_hot_lines(spark, d), _suppliers(spark, d).hint("merge"), ["k"], salt_factor=4)


@query(f"SELECT k, l_orderkey, l_linenumber, s_name FROM (SELECT l_orderkey, l_linenumber, nullif({HOT}, 7) AS k FROM lineitem) l LEFT JOIN (SELECT nullif(s_suppkey, 9) AS k, s_name FROM supplier) s USING (k)")
def salt_null_keys(spark: SparkSession, d: str) -> DataFrame:
    lines = _hot_lines(spark, d).withColumn("k", F.expr("nullif(k, 7)"))
    return auto_salt_join(lines, _suppliers(spark, d).withColumn("k", F.expr("nullif(k, 9)")), ["k"], "left", _AUTO)


@query(f"SELECT k, k2, l_orderkey, l_linenumber, s_name FROM (SELECT l_orderkey, l_linenumber, {HOT} AS k, l_orderkey % 2 AS k2 FROM lineitem) l JOIN (SELECT s_suppkey AS k, s_suppkey % 2 AS k2, s_name FROM supplier) s USING (k, k2)")
def salt_composite(spark: SparkSession, d: str) -> DataFrame:
    lines = _hot_lines(spark, d).withColumn("k2", F.col("l_orderkey") % 2)
    return auto_salt_join(lines, _suppliers(spark, d).withColumn("k2", F.col("k") % 2), ["k", "k2"], "inner", _AUTO)


# -- Hints ----------------------------------------------------------------------------------------------------------------

HINTED = "SELECT {} s_name, count(*) AS n, max(l.l_quantity) AS most FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY s_name"


def _views(spark: SparkSession, d: str) -> None:
    for name in ("lineitem", "supplier"):
        t(spark, d, name).createOrReplaceTempView(name)


def _hinted(hint: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        _views(spark, d)
        return hinted_sql(spark, HINTED.format(f"/*+ {hint} */"))

    return run


for _key, _hint in (("split_broadcast", "SPLIT_BROADCAST(s, 4)"), ("salt", "SALT(s, 4)"), ("targeted_salt", "TARGETED_SALT(s, 4, 1, 2)"), ("broadcast", "BROADCAST(s)"), ("repartition", "REPARTITION(6)")):
    query(HINTED.format(""), f"hint_{_key}")(_hinted(_hint))


@query(HINTED.format(""))
def hint_objects(spark: SparkSession, d: str) -> DataFrame:
    _views(spark, d)
    return apply_hints(spark.sql(HINTED.format("")), [Broadcast(("s",)), Repartition(8)])[0]


@query(HINTED.format(""))
def hint_coalesce(spark: SparkSession, d: str) -> DataFrame:
    _views(spark, d)
    return apply_hints(spark.sql(HINTED.format("")), [Coalesce(2)])[0]


@query(HINTED.format(""))
def hint_rebalance(spark: SparkSession, d: str) -> DataFrame:
    _views(spark, d)
    return apply_hints(spark.sql(HINTED.format("")), [Rebalance()])[0]


# -- Diagnostics: suppliers as stages, their lines as tasks; orders' customers' nations as stages ---------------------------

RUN = "l_extendedprice * CASE WHEN l_orderkey % 97 = 0 THEN 4 ELSE 1 END * CASE WHEN l_suppkey % 10 = 0 THEN CAST(0.002 AS double) ELSE CAST(1 AS double) END"
DELAY, FETCH = "l_extendedprice * l_tax * 15", "l_extendedprice * l_discount * 8"
TASK_SQL = f"""SELECT l_suppkey::INT AS stage_id, 0 AS attempt_id, {RUN} AS run_time_ms, {DELAY} AS scheduler_delay_ms,
    l_partkey % 250 AS deser_ms, l_linenumber * 40.0 AS result_ser_ms, l_orderkey % 70 * 1048576.0 AS result_bytes, {FETCH} AS fetch_wait_ms FROM lineitem"""
STAGE_SQL = """SELECT o_custkey::INT AS stage_id, 0 AS attempt_id, 'stage' AS name, CASE WHEN o_custkey % 50 = 0 THEN 'FAILED' ELSE 'COMPLETE' END AS status, (count(*) * 10)::INT AS num_tasks, (count(*) * 9)::INT AS num_complete,
    count(*) FILTER (WHERE o_orderkey % 9 = 0)::INT AS num_failed, count(*) FILTER (WHERE o_orderkey % 11 = 0)::INT AS num_speculative, floor(max(o_totalprice))::BIGINT AS run_time_ms,
    floor(min(o_totalprice))::BIGINT * 1000000 AS cpu_time_ns, (floor(max(o_totalprice))::BIGINT * (o_custkey % 30)) // 100 AS gc_time_ms, 1000000::BIGINT AS input_bytes, (o_custkey % 3) * 1000000 AS shuffle_read_bytes,
    (o_custkey % 25) * 1000000 AS shuffle_write_bytes, (o_custkey % 7) * 40000000 AS remote_bytes_to_disk, 0::BIGINT AS mem_spill_bytes, (o_custkey % 4) * 90000000 AS disk_spill_bytes FROM orders GROUP BY o_custkey"""


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").selectExpr("CAST(l_suppkey AS int) AS stage_id", "0 AS attempt_id", "l_orderkey AS task_id", f"{RUN} AS run_time_ms", f"{DELAY} AS scheduler_delay_ms", "CAST(l_partkey % 250 AS double) AS deser_ms", "CAST(l_linenumber * 40 AS double) AS result_ser_ms", "CAST(l_orderkey % 70 * 1048576 AS double) AS result_bytes", f"{FETCH} AS fetch_wait_ms")


def _task_stages(spark: SparkSession, d: str) -> DataFrame:
    """Stages of those tasks, with nothing else to find."""
    s = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("stage_id")).agg(F.count(F.lit(1)).cast("int").alias("num_tasks"))
    zero = {c: F.lit(0).cast("long") for c in ("run_time_ms", "cpu_time_ns", "gc_time_ms", "input_bytes", "shuffle_read_bytes", "shuffle_write_bytes", "remote_bytes_to_disk", "mem_spill_bytes", "disk_spill_bytes")}
    return s.withColumns({"attempt_id": F.lit(0), "name": F.lit("stage"), "status": F.lit("COMPLETE"), "num_complete": F.col("num_tasks"), "num_failed": F.lit(0), "num_speculative": F.lit(0), **zero})


def _stages(spark: SparkSession, d: str) -> DataFrame:
    when = lambda c: f"CAST(count_if({c}) AS int)"
    o = t(spark, d, "orders").groupBy("o_custkey").agg(
        F.expr("CAST(count(1) * 10 AS int)").alias("num_tasks"), F.expr("CAST(count(1) * 9 AS int)").alias("num_complete"), F.expr(when("o_orderkey % 9 = 0")).alias("num_failed"),
        F.expr(when("o_orderkey % 11 = 0")).alias("num_speculative"), F.expr("CAST(floor(max(o_totalprice)) AS long)").alias("run_time_ms"), F.expr("CAST(floor(min(o_totalprice)) AS long) * 1000000").alias("cpu_time_ns"),
    )
    k = F.col("o_custkey")
    return o.select(
        k.cast("int").alias("stage_id"), F.lit(0).alias("attempt_id"), F.lit("stage").alias("name"), F.when(k % 50 == 0, "FAILED").otherwise("COMPLETE").alias("status"), "num_tasks", "num_complete", "num_failed",
        "num_speculative", "run_time_ms", "cpu_time_ns", F.expr("(run_time_ms * (o_custkey % 30)) DIV 100").alias("gc_time_ms"), F.lit(1_000_000).cast("long").alias("input_bytes"), (k % 3 * 1_000_000).alias("shuffle_read_bytes"),
        (k % 25 * 1_000_000).alias("shuffle_write_bytes"), (k % 7 * 40_000_000).alias("remote_bytes_to_disk"), F.lit(0).cast("long").alias("mem_spill_bytes"), (k % 4 * 90_000_000).alias("disk_spill_bytes"),
    )


def _issues(stages: DataFrame, tasks: DataFrame) -> DataFrame:
    spark = stages.sparkSession
    return I.detect(stages, tasks, spark.createDataFrame([], I.EXECUTORS), spark.createDataFrame([], I.BROADCASTS), IssueSettings(), cores=200)


def task_issues(spark: SparkSession, d: str) -> DataFrame:
    return _issues(_task_stages(spark, d), _tasks(spark, d))


def stage_issues(spark: SparkSession, d: str) -> DataFrame:
    return _issues(_stages(spark, d), spark.createDataFrame([], I.TASKS))


def _q(metric: str, q: float) -> str:
    return f"list_sort(list({metric}))[least(floor({q} * count(*))::INT, count(*)::INT - 1) + 1]"


QUANTILE_SQL = f"""(SELECT stage_id, count(*) AS n, {_q('run_time_ms', 0.25)} AS r25, {_q('run_time_ms', 0.5)} AS r50, {_q('run_time_ms', 0.75)} AS r75, {_q('run_time_ms', 1.0)} AS r100,
    {_q('scheduler_delay_ms', 0.5)} AS s50, {_q('scheduler_delay_ms', 0.95)} AS s95, {_q('deser_ms', 0.95)} AS d95, {_q('result_ser_ms', 0.95)} AS e95, {_q('result_bytes', 0.95)} AS b95, {_q('fetch_wait_ms', 0.5)} AS f50
    FROM ({TASK_SQL}) GROUP BY stage_id)"""


def _issue_sql(title: str, table: str, when: str, savings: str = "NULL", kind: str = "", severity: str = "'Warning'") -> str:
    return f"SELECT {severity} AS severity, stage_id, '{title}' AS title, floor({savings})::BIGINT AS savings_ms, '{kind}' AS savings_type FROM {table} WHERE {when}"


STAGE_TABLE = f"(SELECT *, floor(run_time_ms / num_complete) AS avg_ms, gc_time_ms / run_time_ms AS gc, cpu_time_ns / 1e6 AS cpu_ms, shuffle_write_bytes / input_bytes AS amp FROM ({STAGE_SQL}) WHERE status = 'COMPLETE')"
ANY_STAGE = f"(SELECT *, floor(run_time_ms / num_complete) AS avg_ms FROM ({STAGE_SQL}))"
DISK = "floor({} * 2 / 52428800) * 1000"
TASK_ISSUES = {
    "skew": _issue_sql("Data Skew", QUANTILE_SQL, "r50 > 0 AND r100 / r50 >= 3", "r100 - r50", "Wall-clock", "CASE WHEN r100 / r50 >= 5 THEN 'Critical' ELSE 'Warning' END"),
    "straggler": _issue_sql("Straggler Tasks", QUANTILE_SQL, "r75 > r25 AND r100 > r75 + 1.5 * (r75 - r25)", "r100 - (r75 + 1.5 * (r75 - r25))", "Wall-clock"),
    "large_result": _issue_sql("Large Task Result", QUANTILE_SQL, "b95 >= 50 * 1048576"),
    "deserialization": _issue_sql("High Task Deserialization", QUANTILE_SQL, "d95 >= 200", "d95 * n", "Compute"),
    "fetch_wait": _issue_sql("High Shuffle Fetch Wait", QUANTILE_SQL, "r50 > 0 AND f50 / r50 >= 0.2", "f50", "Wall-clock"),
    "scheduler_delay": _issue_sql("High Scheduler Delay", QUANTILE_SQL, "s95 >= 500 AND r50 > 0 AND s50 / r50 >= 0.5", "s95 * n", "Scheduling overhead"),
    "result_serialization": _issue_sql("Slow Result Serialization", QUANTILE_SQL, "e95 >= 200", "e95 * n", "Compute"),
    "small_tasks": _issue_sql("Small Tasks (Over-partitioned)", QUANTILE_SQL, "n >= 100 AND r50 < 200", "s50 * n", "Scheduling overhead"),
}
STAGE_ISSUES = {
    "gc": _issue_sql("GC Pressure", STAGE_TABLE, "gc >= 0.1", "gc_time_ms", "Compute", "CASE WHEN gc >= 0.2 THEN 'Critical' ELSE 'Warning' END"),
    "spill": _issue_sql("Shuffle Spill", STAGE_TABLE, "disk_spill_bytes > 0", DISK.format("disk_spill_bytes"), "I/O"),
    "speculative": _issue_sql("Speculative Tasks", STAGE_TABLE, "num_speculative > 0", "num_speculative * avg_ms", "Compute"),
    "under_partitioned": _issue_sql("Under-partitioned Stage", STAGE_TABLE, "num_tasks > 0 AND num_tasks < 100"),
    "amplification": _issue_sql("Shuffle Amplification", STAGE_TABLE, "shuffle_write_bytes > 0 AND amp >= 5", severity="CASE WHEN amp >= 20 THEN 'Critical' ELSE 'Warning' END"),
    "low_cpu": _issue_sql("Low CPU Utilization", STAGE_TABLE, "run_time_ms >= 60000 AND cpu_time_ns > 0 AND cpu_ms / run_time_ms < 0.5", "run_time_ms - cpu_ms", "Compute", "CASE WHEN cpu_ms / run_time_ms < 0.25 THEN 'Critical' ELSE 'Warning' END"),
    "disk_read": _issue_sql("Disk Shuffle Read", STAGE_TABLE, "shuffle_read_bytes > 0 AND remote_bytes_to_disk >= 104857600", DISK.format("remote_bytes_to_disk"), "I/O"),
    "failures": _issue_sql("Task Failures", ANY_STAGE, "num_failed > 0", "num_failed * avg_ms", "Compute", "'Critical'"),
}
SHOWN = ["severity", "stage_id", "title", "savings_ms", "savings_type"]


def _of(source: Query, title: str) -> Query:
    return lambda s, d: source(s, d).where(F.col("title") == title).select(*SHOWN)


for _source, _table in ((task_issues, TASK_ISSUES), (stage_issues, STAGE_ISSUES)):
    for _key, _sql in _table.items():
        query(_sql, f"issue_{_key}")(_of(_source, _sql.split("stage_id, '")[1].split("'")[0]))

ALL_STAGE = " UNION ALL ".join(STAGE_ISSUES.values())
ALL_TASK = " UNION ALL ".join(TASK_ISSUES.values())


@query("SELECT 'Critical' AS severity, o_orderkey::INT % 100 AS stage_id, 'Stage Retry' AS title, (count(*) - 1) * 10 * 5 AS savings_ms, 'Compute' AS savings_type FROM orders GROUP BY 2 HAVING count(*) > 1")
def issue_stage_retry(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").selectExpr("CAST(o_orderkey AS int) % 100 AS stage_id", "CAST(o_orderkey AS int) AS attempt_id", "10 AS num_tasks", "10 AS num_complete", "0 AS num_failed", "50L AS run_time_ms")
    return I.failure_issues(o).select(*SHOWN)


@query("SELECT 'Warning' AS severity, NULL::INT AS stage_id, 'Executor Memory Skew' AS title, NULL::BIGINT AS savings_ms, '' AS savings_type FROM customer WHERE c_acctbal > 0 HAVING count(*) >= 3 AND stddev_pop(floor(c_acctbal)) / avg(floor(c_acctbal)) >= 0.5 UNION ALL SELECT 'Warning', NULL, 'Large Broadcast', NULL, '' FROM part WHERE p_size * 10 * 1048576 >= 200 * 1048576")
def issue_application(spark: SparkSession, d: str) -> DataFrame:
    executors = t(spark, d, "customer").selectExpr("c_name AS executor_id", "true AS is_active", "4 AS total_cores", "CAST(floor(c_acctbal) AS long) AS peak_jvm_heap", "10000L AS max_memory")
    broadcasts = t(spark, d, "part").selectExpr("p_name AS name", "CAST(p_size AS long) * 10 * 1048576 AS bytes")
    return I.application_issues(executors, broadcasts, IssueSettings()).select(*SHOWN)


@query(f"SELECT count(*) AS issues, count(*) FILTER (WHERE severity = 'Critical') AS critical, count(*) FILTER (WHERE severity = 'Warning') AS warnings, coalesce(sum(savings_ms) FILTER (WHERE savings_type = 'Wall-clock'), 0)::BIGINT AS wall_ms, coalesce(sum(savings_ms) FILTER (WHERE savings_type NOT IN ('Wall-clock', '')), 0)::BIGINT AS other_ms FROM ({ALL_STAGE})")
def overview_totals(spark: SparkSession, d: str) -> DataFrame:
    return report.overview(stage_issues(spark, d))


@query(f"""SELECT stage_id, count(*) AS issues, wall_ms, compute_ms, wall_ms + compute_ms AS total_ms, CASE WHEN wall_ms + compute_ms > 60000 THEN 'high' WHEN wall_ms + compute_ms > 5000 THEN 'raised' ELSE 'normal' END AS band
    FROM (SELECT *, coalesce(sum(savings_ms) FILTER (WHERE savings_type = 'Wall-clock') OVER w, 0)::BIGINT AS wall_ms, coalesce(sum(savings_ms) FILTER (WHERE savings_type NOT IN ('Wall-clock', '')) OVER w, 0)::BIGINT AS compute_ms FROM ({ALL_TASK}) WINDOW w AS (PARTITION BY stage_id)) GROUP BY ALL""")
def stage_savings(spark: SparkSession, d: str) -> DataFrame:
    return report.stages(task_issues(spark, d))


def _cause_sql(all_issues: str) -> str:
    """Causes as SQL: where each holds, and which claims an issue first."""
    causes = ", ".join(f"({i}, '{c.name}', '{c.primary}', {list(c.secondary)!r})" for i, c in enumerate(R.CAUSES))
    return f"""WITH i AS ({all_issues}), c(rank, name, first, others) AS (VALUES {causes}),
      s AS (SELECT coalesce(stage_id, -1) AS stage, list(DISTINCT title) AS titles FROM i GROUP BY 1),
      h AS (SELECT rank, stage FROM s, c WHERE list_contains(titles, first) AND list_has_any(titles, others)),
      a AS (SELECT rank, NULL::INT AS stage FROM (SELECT list(DISTINCT title) AS titles FROM i), c WHERE list_contains(titles, first) AND list_has_any(titles, others) AND rank NOT IN (SELECT rank FROM h)),
      m AS (SELECT i.*, (SELECT min(c.rank) FROM c, (SELECT * FROM h UNION ALL SELECT * FROM a) x WHERE c.rank = x.rank AND (x.stage IS NULL OR x.stage = coalesce(i.stage_id, -1)) AND list_contains(list_append(c.others, c.first), i.title)) AS rank FROM i)
      SELECT c.name, array_to_string(list_sort(list(DISTINCT title)), ',') AS titles, count(DISTINCT stage_id) AS n_stages,
        coalesce(max(savings_ms) FILTER (WHERE savings_type = 'Wall-clock'), 0) AS wall_ms, coalesce(max(savings_ms) FILTER (WHERE savings_type NOT IN ('Wall-clock', '')), 0) AS compute_ms FROM m JOIN c USING (rank) GROUP BY c.name"""


def _causes(issues: DataFrame) -> DataFrame:
    return R.root_causes(issues).select("name", F.array_join("titles", ",").alias("titles"), F.size("stages").cast("long").alias("n_stages"), "wall_ms", "compute_ms")


query(_cause_sql(ALL_STAGE), "root_causes_stages")(lambda s, d: _causes(stage_issues(s, d)))
query(_cause_sql(ALL_TASK), "root_causes_tasks")(lambda s, d: _causes(task_issues(s, d)))


@query(f"SELECT stage_id, r50 AS run_time_ms_50, r100 AS run_time_ms_100 FROM {QUANTILE_SQL}")
def view_skew(spark: SparkSession, d: str) -> DataFrame:
    return I.view("skew", _task_stages(spark, d), _tasks(spark, d)).drop("name")


@query(f"SELECT stage_id, run_time_ms, gc_time_ms FROM {STAGE_TABLE}")
def view_gc(spark: SparkSession, d: str) -> DataFrame:
    return I.view("gc", _stages(spark, d), spark.createDataFrame([], I.TASKS)).drop("name")


_PAGES = {
    "stragglers": ("TASK", "r50 AS run_time_ms_50, r75 AS run_time_ms_75, r100 AS run_time_ms_100"),
    "small_tasks": ("TASK", "n::INT AS num_tasks, r50 AS run_time_ms_50, s50 AS scheduler_delay_ms_50"),
    "large_result": ("TASK", "n::INT AS num_tasks, b95 AS result_bytes_95"),
    "fetch_wait": ("TASK", "r50 AS run_time_ms_50, f50 AS fetch_wait_ms_50"),
    "deserialization": ("TASK", "n::INT AS num_tasks, d95::DOUBLE AS deser_ms_95"),
    "scheduler_delay": ("TASK", "s50 AS scheduler_delay_ms_50, s95 AS scheduler_delay_ms_95, r50 AS run_time_ms_50"),
    "slow_serialization": ("TASK", "n::INT AS num_tasks, e95::DOUBLE AS result_ser_ms_95"),
    "spill": ("STAGE", "mem_spill_bytes, disk_spill_bytes, remote_bytes_to_disk"),
    "under_partitioned": ("STAGE", "num_tasks, run_time_ms"),
    "amplification": ("STAGE", "input_bytes, shuffle_write_bytes"),
    "failures": ("STAGE", "num_tasks, num_failed, avg_ms::BIGINT AS avg_task_ms"),
    "speculative": ("STAGE", "num_tasks, num_speculative, avg_ms::BIGINT AS avg_task_ms"),
    "low_cpu": ("STAGE", "run_time_ms, cpu_time_ns"),
    "disk_read": ("STAGE", "shuffle_read_bytes, remote_bytes_to_disk"),
}
for _page, (_table, _columns) in _PAGES.items():
    if _table == "TASK":
        query(f"SELECT stage_id, {_columns} FROM {QUANTILE_SQL}", f"view_{_page}")(lambda s, d, p=_page: I.view(p, _task_stages(s, d), _tasks(s, d)).drop("name"))
    else:
        query(f"SELECT stage_id, {_columns} FROM {STAGE_TABLE}", f"view_{_page}")(lambda s, d, p=_page: I.view(p, _stages(s, d), s.createDataFrame([], I.TASKS)).drop("name"))


@query("SELECT o_orderkey::INT % 100 AS stage_id, count(*) AS attempts, max(o_orderkey::INT % 7) AS num_tasks FROM orders GROUP BY 1 HAVING count(*) > 1")
def view_retries(spark: SparkSession, d: str) -> DataFrame:
    return I.retries_view(t(spark, d, "orders").selectExpr("CAST(o_orderkey AS int) % 100 AS stage_id", "CAST(o_orderkey AS int) % 7 AS num_tasks"))


@query("SELECT c_name AS executor_id, c_custkey AS peak_jvm_heap, 1400::BIGINT AS max_memory, round(c_custkey / 1400.0, 4)::DOUBLE AS used, CASE WHEN c_custkey / 1400.0 >= 0.9 THEN 'high' WHEN c_custkey / 1400.0 >= 0.7 THEN 'raised' ELSE 'normal' END AS band FROM customer")
def view_executors(spark: SparkSession, d: str) -> DataFrame:
    return I.executor_view(t(spark, d, "customer").selectExpr("c_name AS executor_id", "c_custkey AS peak_jvm_heap", "1400L AS max_memory"))


@query("SELECT p_name AS name, p_size * 10485760::BIGINT AS bytes, round(p_size * 10.0, 1)::DOUBLE AS mib, p_size >= 20 AS large FROM part")
def view_broadcasts(spark: SparkSession, d: str) -> DataFrame:
    return I.broadcast_view(t(spark, d, "part").selectExpr("p_name AS name", "CAST(p_size AS long) * 10485760 AS bytes"), IssueSettings())


# -- Decisions, plans and advice: text in, rows out; tests hold them against fixtures ---------------------------------------


#: Sizes in MiB of the sides of a join, for each order, and whether the advice is forced.
SIDES = ("o_custkey % 400", "o_custkey % 400 * (o_orderkey % 30)", "o_orderkey % 11 = 0")


@query(f"""SELECT o_orderkey, CASE WHEN s < 10 OR (NOT f AND g < s * 10) THEN 'none' WHEN s <= 100 THEN 'SPLIT_BROADCAST(t, ' || greatest(2, ceil(s / 10.0)::INT) || ')' ELSE 'SALT(t, 16)' END AS advice
    FROM (SELECT o_orderkey, {SIDES[0]} AS s, {SIDES[1]} AS g, {SIDES[2]} AS f FROM orders)""")
def advisor_skew_strategy(spark: SparkSession, d: str) -> DataFrame:
    from .autofix.advisor import skew_strategy

    mb = 1 << 20

    def run(frames):
        for x in frames:
            advice = [h.render() if (h := skew_strategy("t", s * mb, g * mb, 10 * mb, 100 * mb, 10.0, 16, f)) else "none" for s, g, f in zip(x["s"].tolist(), x["g"].tolist(), x["f"].tolist(), strict=True)]
            yield x[["o_orderkey"]].assign(advice=advice)

    return t(spark, d, "orders").selectExpr("o_orderkey", f"{SIDES[0]} AS s", f"{SIDES[1]} AS g", f"{SIDES[2]} AS f").mapInPandas(run, "o_orderkey long, advice string")


@query("""SELECT o_orderkey, CASE WHEN b <= 0 THEN 'none' WHEN p / w >= 3 THEN 'COALESCE(' || w::BIGINT || ')' WHEN p / w <= 0.33 THEN 'REPARTITION(' || w::BIGINT || ')' ELSE 'none' END AS advice
    FROM (SELECT o_orderkey, b, p, greatest(1, b // 128) AS w FROM (SELECT o_orderkey, o_custkey * (o_orderkey % 40) AS b, 1.0 + o_orderkey % 300 AS p FROM orders))""")
def advisor_partitions(spark: SparkSession, d: str) -> DataFrame:
    from .autofix.advisor import partition_advice

    mb = 1 << 20

    def run(frames):
        for x in frames:
            advice = [h.render() if (h := partition_advice(b * mb, p, 128 * mb)) else "none" for b, p in zip(x["b"].tolist(), x["p"].tolist(), strict=True)]
            yield x[["o_orderkey"]].assign(advice=advice)

    return t(spark, d, "orders").selectExpr("o_orderkey", "o_custkey * (o_orderkey % 40) AS b", "1 + o_orderkey % 300 AS p").mapInPandas(run, "o_orderkey long, advice string")


#: Plans of executions: each event is one, of the plan numbered by its id, with these metrics.
PLANS = (
    "SortMergeJoin [a#1], [b#2], Inner\n:- Exchange hashpartitioning(a#1, 200)\n:  +- FileScan parquet t[a#1] PartitionFilters: [], PushedFilters: [IsNotNull(a)]\n+- Exchange hashpartitioning(b#2, 200)\n   +- FileScan csv u[b#2]",
    "AdaptiveSparkPlan isFinalPlan=true\n+- HashAggregate(keys=[a#1])\n   +- Exchange hashpartitioning(a#1, 200)\n      +- FileScan json t[a#1]",
    "CartesianProduct\n:- FileScan parquet t[a#1] Location: InMemoryFileIndex[file:/t]\n+- FileScan parquet t[a#3] Location: InMemoryFileIndex[file:/t]",
    "CollectLimit 10\n+- BatchEvalPython [f(a#1)]\n   +- FileScan parquet t[a#1]",
)
WRITES, READS = "event_id % 40 * 1048576 * (event_id % 3)", "event_id % 5000 * 1048576"
_P, _W, _R, _T = "event_id % 4", f"({WRITES})", f"({READS})", "'{}' AS title"
#: For each title: when it is suggested, and how severely.
SUGGESTED = (
    ("Broadcast Join Candidate", f"{_P} = 0 AND {_W} BETWEEN 1 AND 104857600", f"CASE WHEN {_W} < 10485760 THEN 'Critical' ELSE 'Warning' END"),
    ("AQE Not Enabled", f"{_P} = 0", "CASE WHEN event_id % 7 = 0 THEN 'Warning' ELSE 'Info' END"),
    ("Cartesian Product", f"{_P} = 2", "'Critical'"),
    ("Suboptimal File Format", f"{_P} IN (0, 1)", "'Info'"),
    ("Missing Partition Pruning", f"{_P} = 0 AND {_R} >= 1073741824", "'Warning'"),
    ("Python UDF Detected", f"{_P} = 3", "'Warning'"),
    ("Repeated Table Scan", f"{_P} = 2", "'Warning'"),
    ("Collect on Large Dataset", f"{_P} = 3 AND {_R} >= 104857600", f"CASE WHEN {_R} > 1073741824 THEN 'Critical' ELSE 'Warning' END"),
    ("Shuffle Partition Tuning", f"{_P} = 0 AND {_W} > 0", "'Warning'"),
)


@query(" UNION ALL ".join(f"SELECT event_id AS execution_id, {_T.format(title)}, {severity} AS severity FROM events WHERE {when}" for title, when, severity in SUGGESTED))
def suggestions_by_execution(spark: SparkSession, d: str) -> DataFrame:
    from .analysis.suggestions import suggest_rows

    plan = F.element_at(F.array(*[F.lit(p) for p in PLANS]), (F.col("event_id") % 4 + 1).cast("int"))
    titles = F.when(F.col("event_id") % 7 == 0, F.array(F.lit("Data Skew"))).otherwise(F.array().cast("array<string>"))
    runs = t(spark, d, "events").select(F.col("event_id").alias("execution_id"), plan.alias("plan"), F.array(F.expr(WRITES)).alias("shuffle_write"), F.array(F.expr(READS)).alias("input_bytes"), titles.alias("issue_titles"))
    return suggest_rows(runs, 200).select("execution_id", "title", "severity")


@query("SELECT * FROM (VALUES (1, 'optimizing', 1000, 1000, 'BROADCAST(s)'), (2, 'optimizing', 1000, 500, 'BROADCAST(s), REPARTITION(8)'), (3, 'converged', 1000, 500, 'BROADCAST(s)')) x(run, status, baseline_ms, best_ms, pending)")
def policy_runs(spark: SparkSession, d: str) -> DataFrame:
    from .autofix.policy import update
    from .autofix.profile import Profile

    p, out = Profile("f"), []
    advice = [Broadcast(("s",)), Repartition(8)]
    for i, ms in enumerate((1000, 500, 900), 1):
        p = update(p, p.next_hints(), ms, advice, 2, now_ms=i)
        out.append((i, p.status, p.baseline_ms, p.best_ms, ", ".join(h.render() for h in p.pending_hints)))
    return spark.createDataFrame(out, "run int, status string, baseline_ms int, best_ms int, pending string")


@query()
def suggestions_of_plan(spark: SparkSession, d: str) -> DataFrame:
    from .analysis.suggestions import Execution, suggest, suggestions_frame
    from .plans.internals import formatted_plan

    li, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    plan = li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey).groupBy("o_orderpriority").count()
    return suggestions_frame(spark, suggest(Execution(1, formatted_plan(plan), frozenset({1}), {1: 5 << 20}, {1: 2 << 30}), 200))


#: Applications: nations. Each customer is an issue of its nation's: of a title by number where this holds, else one that no
#: rule asks for.
ISSUE_TITLES = ("GC Pressure", "Shuffle Spill", "Straggler Tasks", "High Shuffle Fetch Wait", "Disk Shuffle Read", "Task Failures", "Stage Retry", "Slow Result Serialization", "High Task Deserialization")
APP_ISSUE = ("c_custkey % 9", "(c_nationkey + c_custkey % 9) % 4 < 2", "CASE WHEN c_acctbal > 9000 AND c_nationkey % 2 = 0 THEN 'Critical' ELSE 'Warning' END", "c_custkey % 1000")
APP_SETTINGS = {
    "spark.memory.offHeap.enabled": ("true", 4), "spark.memory.fraction": ("0.4", 5), "spark.serializer": ("org.apache.spark.serializer.KryoSerializer", 6), "spark.speculation": ("true", 2), "spark.shuffle.service.enabled": ("true", 3),
}
_SET = lambda key: f"app % {APP_SETTINGS[key][1]} = 0"
_HAS = lambda *at: "(" + " OR ".join(f"coalesce(m[{i}], -1) >= 0" for i in at) + ")"
_SAVES = lambda *at: "(" + " + ".join(f"coalesce(m[{i}], 0)" for i in at) + ")"
#: Key, title, when, severity, savings; m: the savings of each title that occurs, by its number; worst: of the first.
CONFIG_RULES = (
    ("spark.shuffle.spill.numElementsForceSpillThreshold", "Spill large buffers earlier", _HAS(0), "worst", _SAVES(0)),
    ("spark.memory.offHeap.enabled", "Move execution memory off the heap", f"{_HAS(0)} AND NOT {_SET('spark.memory.offHeap.enabled')}", "worst", _SAVES(0)),
    ("spark.executor.memory", "Give executors more memory", f"worst = 'Critical' AND NOT {_HAS(1)}", "'Critical'", _SAVES(0)),
    ("spark.executor.memory", "Give executors more memory, to spill less", _HAS(1), "'Warning'", _SAVES(1)),
    ("spark.memory.fraction", "Raise the memory fraction", f"{_HAS(1)} AND {_SET('spark.memory.fraction')}", "'Warning'", _SAVES(1)),
    ("spark.serializer", "Serialize by Kryo", f"{_HAS(0, 7, 8)} AND NOT {_SET('spark.serializer')}", f"CASE WHEN {_HAS(7, 8)} THEN 'Warning' ELSE 'Info' END", f"nullif({_SAVES(7, 8)}, 0)"),
    ("spark.speculation", "Run slow tasks twice", f"{_HAS(2)} AND NOT {_SET('spark.speculation')}", "'Warning'", _SAVES(2)),
    ("spark.reducer.maxSizeInFlight", "Fetch more shuffle data at once", _HAS(3), "'Warning'", _SAVES(3)),
    ("spark.shuffle.service.enabled", "Use the external shuffle service", f"{_HAS(3)} AND NOT {_SET('spark.shuffle.service.enabled')}", "'Info'", "NULL"),
    ("spark.maxRemoteBlockSizeFetchToMem", "Keep fetched blocks in memory", _HAS(4), "'Warning'", _SAVES(4)),
    ("spark.executor.memory", "Give executors more memory, to fail less", _HAS(5, 6), "'Warning'", f"nullif({_SAVES(5, 6)}, 0)"),
)
_FOUND = f"""(SELECT app, map(list(t), list(ms)) AS m, CASE WHEN bool_or(t = 0 AND critical) THEN 'Critical' WHEN bool_or(t = 0) THEN 'Warning' ELSE 'Info' END AS worst FROM
    (SELECT c_nationkey AS app, CASE WHEN {APP_ISSUE[1]} THEN {APP_ISSUE[0]} ELSE -1 END AS t, sum({APP_ISSUE[3]})::BIGINT AS ms, bool_or({APP_ISSUE[2]} = 'Critical') AS critical FROM customer GROUP BY 1, 2) GROUP BY app)"""


@query(
    "SELECT app, config_key, severity, title, savings_ms FROM (SELECT *, row_number() OVER (PARTITION BY app, config_key ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'Warning' THEN 1 ELSE 2 END, place) AS r FROM ("
    + " UNION ALL ".join(f"SELECT app, {i} AS place, '{key}' AS config_key, {severity} AS severity, '{title}' AS title, {saves}::BIGINT AS savings_ms FROM {_FOUND} WHERE {when}" for i, (key, title, when, severity, saves) in enumerate(CONFIG_RULES))
    + ")) WHERE r = 1"
)
def config_advice(spark: SparkSession, d: str) -> DataFrame:
    from .analysis.config_advice import advise_rows

    c = t(spark, d, "customer").withColumn("app", F.col("c_nationkey"))
    title = F.element_at(F.array(*[F.lit(x) for x in ISSUE_TITLES]), (F.expr(APP_ISSUE[0]) + 1).cast("int"))
    title = F.when(F.expr(APP_ISSUE[1]), title).otherwise(F.lit("Data Skew"))
    found = c.select("app", F.expr(APP_ISSUE[2]).alias("severity"), title.alias("title"), F.expr(APP_ISSUE[3]).alias("savings_ms"))
    set_ = F.map_filter(F.create_map(*[x for k, (v, n) in APP_SETTINGS.items() for x in (F.lit(k), F.when(F.col("app") % n == 0, F.lit(v)))]), lambda k, v: v.isNotNull())
    return advise_rows(found, c.select("app").distinct().withColumn("properties", set_)).select("app", "config_key", "severity", "title", "savings_ms")
