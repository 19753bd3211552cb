import pytest
from pyspark.sql import functions as F

from keelson.config import ResilientSettings
from keelson.operators.joins import (
    AutoSaltConfig, BroadcastStrategy, FailureContext, JoinConfig, RepartitionStrategy, ResilientJoinExhausted, ShuffledHashStrategy, SortMergeStrategy, SplitBroadcastConfig, SplitBroadcastExhausted,
    auto_salt_join, hot_keys, resilient_join, salted_join, split_broadcast_join, split_join,
)
from keelson.operators.joins import split_broadcast
from keelson.operators.joins.resilient import engine_join
from keelson.operators.joins.split_broadcast import next_splits, parsed_size
from keelson.operators.joins.strategies import known_size
from keelson.plans.internals import executed_plan, size_in_bytes

from .conftest import rows


@pytest.fixture
def sides(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, l string"), spark.createDataFrame([(2, "x"), (3, "y"), (4, "z")], "id int, r string")


class Fake:
    def __init__(self, name, error=None, declines=False):
        self.name, self.error, self.declines, self.seen = name, error, declines, []

    def can_handle(self, left, right, how, previous):
        self.seen.append(previous)
        return not self.declines

    def join(self, left, right, keys, how, previous):
        if self.error:
            raise self.error
        return left.join(right, keys, how)


@pytest.mark.parametrize(("how", "n"), [("inner", 2), ("left_outer", 3), ("right_outer", 3), ("full_outer", 4), ("left_semi", 2), ("left_anti", 1)])
def test_all_strategies_join_alike(sides, how, n):
    left, right = sides
    expected = rows(left.join(right, "id", how))
    assert len(expected) == n
    for s in (BroadcastStrategy(), ShuffledHashStrategy(), SortMergeStrategy(), RepartitionStrategy(4)):
        assert rows(s.join(left, right, ["id"], how, None)) == expected
    assert rows(resilient_join(left, right, ["id"], how)) == expected
    assert rows(engine_join(left, right, ["id"], how, ResilientSettings(enabled=True)).result) == expected


def test_plans(spark):
    left, right = spark.range(1000).withColumn("l", F.lit(1)), spark.range(1000).withColumn("r", F.lit(1))
    for s, node in ((BroadcastStrategy(), "BroadcastHashJoin"), (ShuffledHashStrategy(), "ShuffledHashJoin"), (SortMergeStrategy(), "SortMergeJoin")):
        assert node in executed_plan(s.join(left, right, ["id"], "inner", None))


def test_fallback_skip_context(sides):
    left, right = sides
    broken, declining, last = Fake("broken", RuntimeError("boom")), Fake("declining", declines=True), Fake("last")
    out = resilient_join(left, right, ["id"], config=JoinConfig([broken, declining, last], cache=False))
    assert out.count() == 2
    context = last.seen[0]
    assert (context.strategy, context.attempt) == ("broken", 1) and "boom" in str(context.error) and context.left_bytes > 0


def test_exhaustion(sides):
    left, right = sides
    chain = [Fake(f"s{i}", RuntimeError(f"e{i}")) for i in range(4)]
    with pytest.raises(ResilientJoinExhausted, match=r"s0 \(RuntimeError\) → s1 \(RuntimeError\)") as caught:
        resilient_join(left, right, ["id"], config=JoinConfig(chain, max_attempts=2))
    assert [c.strategy for c in caught.value.contexts] == ["s0", "s1"] and str(caught.value.__cause__) == "e1" and not chain[2].seen


def test_only_memory_failures_lead_on(sides):
    left, right = sides
    with pytest.raises(RuntimeError, match="other"):
        resilient_join(left, right, ["id"], config=JoinConfig([Fake("a", RuntimeError("other")), Fake("b")]), only_memory=True)
    out = resilient_join(left, right, ["id"], config=JoinConfig([Fake("a", RuntimeError("java.lang.OutOfMemoryError")), Fake("b")], cache=False, validate="full"), only_memory=True)
    assert out.count() == 2


def test_broadcast_gate(sides):
    left, right = sides
    assert not BroadcastStrategy(1).can_handle(left, right, "inner", None)
    assert not BroadcastStrategy(1 << 60).can_handle(left, right, "full_outer", None)
    failed = FailureContext("broadcast", RuntimeError("Not enough memory to build and broadcast"), 1, 0, 0)
    assert not BroadcastStrategy(1 << 62).can_handle(left, right, "inner", failed)
    assert RepartitionStrategy(10).partitions(failed) == 20 and RepartitionStrategy(10).partitions(None) == 10
    assert engine_join(left, right, ["id"], settings=ResilientSettings()).strategy == "plain"


# -- Split broadcast ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 4, 8])
def test_split_equals_plain(spark, n):
    large = spark.range(1, 1001).withColumn("v", F.lit(1)).union(spark.sql("SELECT CAST(NULL AS long), 2"))
    small = spark.range(10, 1010, 10).withColumn("w", F.col("id") * 2).union(spark.sql("SELECT 10L, 5L"))
    for how in ("inner", "left_semi"):
        out = split_join(large, small, ["id"], how, n)
        assert rows(out) == rows(large.join(small, "id", how))
        assert executed_plan(out).count("BroadcastHashJoin") >= n


def test_split_cross_composite_rejects(spark):
    a, b = spark.range(3), spark.range(4).toDF("other")
    assert rows(split_join(a, b, [], "cross", 3)) == rows(a.crossJoin(b))
    left = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3), (2, "b", 4)], "k1 int, k2 string, l int")
    right = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k1 int, k2 string, r int")
    assert split_join(left, right, ["k1", "k2"], "inner", 4).count() == 2
    for how in ("left_outer", "full_outer", "left_anti"):
        with pytest.raises(ValueError, match="can't do"):
            split_join(left, right, ["k1", "k2"], how, 2)


@pytest.mark.parametrize(
    ("text", "splits"),
    [("the size of the broadcast table is 524288000 bytes.", 5), ("table of 800.5 MiB", 9), ("2 GB is too much", 21), ("209715200 bytes", 8), ("no size", 8)],
)
def test_next_splits(text, splits):
    error = RuntimeError("outer")
    error.__cause__ = RuntimeError(text)
    assert next_splits(4 if splits == 8 else 1, error, 100 << 20) == splits


def test_parsed_size_order():
    assert parsed_size(RuntimeError("1 KiB")) == 1024 and parsed_size(RuntimeError("nothing")) is None


def test_escalation(spark, monkeypatch):
    from pyspark.errors import PySparkException

    large, small, tried = spark.range(100), spark.range(0, 100, 7).withColumn("w", F.lit(1)), []
    real = split_broadcast.split_join

    class Broken:
        def isEmpty(self):  # noqa: N802
            raise PySparkException("size of the broadcast table is 3000 bytes")

    def failing(*args):
        tried.append(args[-1])
        return Broken() if args[-1] < 3 else real(*args)

    monkeypatch.setattr(split_broadcast, "split_join", failing)
    config = SplitBroadcastConfig(budget_bytes=1000, cache_result=False)
    assert split_broadcast_join(large, small, ["id"], config=config).count() == 15 and tried == [1, 3]
    with pytest.raises(SplitBroadcastExhausted):
        split_broadcast_join(large, small, ["id"], config=SplitBroadcastConfig(budget_bytes=1000, max_splits=2, cache_result=False))


# -- Salt -----------------------------------------------------------------------------------------------------------------


@pytest.fixture
def skewed(spark):
    hot = spark.range(500).select(F.lit(1).alias("id"), F.concat(F.lit("h"), "id").alias("l"))
    cold = spark.range(2, 51).select(F.col("id").cast("int"), F.concat(F.lit("c"), "id").alias("l"))
    none = spark.sql("SELECT CAST(NULL AS int), 'n'")
    right = spark.range(1, 61).select(F.col("id").cast("int"), F.concat(F.lit("r"), "id").alias("r")).union(spark.sql("SELECT CAST(NULL AS int), 'rn'")).union(spark.sql("SELECT 1, 'again'"))
    return hot.union(cold).union(none), right.where("id IS NULL OR id % 9 <> 0")


FULL = AutoSaltConfig(sample_fraction=1.0, cache_result=False)


def test_hot_keys(spark, skewed):
    left, right = skewed
    assert [(r["id"], r["freq"]) for r in hot_keys(left, ["id"], 1.0).collect()] == [(1, 500)]
    assert hot_keys(right, ["id"], 1.0).count() == 0 and hot_keys(left.limit(0), ["id"], 1.0).count() == 0


@pytest.mark.parametrize("how", ["inner", "left_outer", "right_outer"])
def test_auto_salt_equals_plain(skewed, how):
    left, right = skewed
    assert rows(auto_salt_join(left, right, ["id"], how, FULL)) == rows(left.join(right, "id", how))
    assert rows(auto_salt_join(right, left, ["id"], how, FULL)) == rows(right.join(left, "id", how))


def test_salted_plan_has_salt_and_no_cross(skewed):
    left, right = skewed
    out = salted_join(left, right, ["id"], "inner", 4)
    assert rows(out) == rows(left.join(right, "id")) and out.columns == ["id", "l", "r"]
    assert "__keelson_salt" in executed_plan(out) and "Cartesian" not in executed_plan(out)


def test_salt_composite_and_uniform_data(spark, skewed):
    left, right = (df.withColumn("k2", F.col("id") % 3) for df in skewed)
    assert rows(auto_salt_join(left, right, ["id", "k2"], "inner", FULL)) == rows(left.join(right, ["id", "k2"]))
    flat = spark.range(100)
    assert auto_salt_join(flat, flat.withColumn("v", F.lit(1)), ["id"], "inner", FULL).count() == 100


def test_salt_rejects(skewed):
    left, right = skewed
    for how in ("full_outer", "left_semi", "left_anti"):
        with pytest.raises(ValueError, match="can't do"):
            auto_salt_join(left, right, ["id"], how)
    with pytest.raises(ValueError, match="preserves"):
        salted_join(left, right, ["id"], "right_outer", side="left")
    for bad in (dict(sample_fraction=0), dict(multiplier=1), dict(salt_factor=1), dict(side="both")):
        with pytest.raises(ValueError):
            AutoSaltConfig(**bad)


def test_broadcast_is_checked_by_rows(spark, tmp_path):
    """Files may be a small part of their rows: 200 000 rows that repeat take some kilobytes."""
    spark.range(200_000).select((F.col("id") % 2).alias("id"), F.lit(1).cast("long").alias("l")).write.parquet(str(tmp_path / "left"))
    left, right = spark.read.parquet(str(tmp_path / "left")), spark.range(1, 3).withColumn("r", F.lit("r"))
    limit = 1 << 20
    assert size_in_bytes(left) < limit < known_size(left)
    assert not BroadcastStrategy(limit).can_handle(left, right, "right", None) and BroadcastStrategy(64 << 20).can_handle(left, right, "right", None)
    out = resilient_join(left, right, ["id"], "right", JoinConfig(broadcast_threshold_bytes=limit, cache=False))
    assert "SortMergeJoin" in executed_plan(out) and out.count() == 100_001


def test_engine_broadcast_is_checked_by_rows(spark, tmp_path):
    spark.range(200_000).select((F.col("id") % 2000).alias("id"), F.lit(1).cast("long").alias("l")).write.parquet(str(tmp_path / "left"))
    left, right = spark.read.parquet(str(tmp_path / "left")), spark.range(1999, 2001).withColumn("r", F.lit("r"))
    out = engine_join(left, right, ["id"], "right", ResilientSettings(enabled=True, broadcast_threshold=1 << 20))
    assert out.strategy == "shuffled_hash" and out.result.count() == 101


@pytest.mark.parametrize("how", ["inner", "left_semi", "cross"])
def test_split_beyond_the_driver(spark, monkeypatch, how):
    """Parts that the driver can't gather are dealt by a shuffle."""
    left, right = spark.range(100).withColumn("l", F.lit(1)), spark.range(50, 150)
    keys, right = ([], right.withColumnRenamed("id", "r")) if how == "cross" else (["id"], right)
    expected = rows(split_join(left, right, keys, how, 3))
    monkeypatch.setattr(split_broadcast, "driver_heap", lambda _: 100)
    out = split_join(left, right, keys, how, 3)
    assert rows(out) == expected and "Broadcast" not in executed_plan(out)


@pytest.mark.parametrize(("kind", "swap"), [("right", False), ("left", True)])
def test_outer_salt_of_the_side_that_is_not_preserved(spark, skewed, kind, swap):
    """Matches by a salted join, then the rows that have none; equal rows, null keys and equal column names included."""
    left, right = skewed
    left, right = left.withColumnRenamed("l", "v"), right.union(right).withColumnRenamed("r", "v")
    one, two = (right, left) if swap else (left, right)
    out = auto_salt_join(one, two, ["id"], kind, FULL)
    plain = one.join(two, "id", kind)
    assert out.columns == plain.columns and rows(out) == rows(plain) and "__keelson_salt" in executed_plan(out)
