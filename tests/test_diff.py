import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.operators.diff import STRATEGIES, DiffConfig, diff

from .conftest import rows

LEFT = [(1, "alice", 10.0), (2, "bob", 20.0), (3, "carol", 30.0), (4, "dave", 40.0)]
RIGHT = [(1, "alice", 10.0), (2, "bob", 25.0), (3, "carol", 30.0), (5, "eve", 50.0)]
SCHEMA = "id int, name string, value double"


@pytest.fixture(params=STRATEGIES)
def strategy(request):
    return request.param


def test_added_removed_changed(spark, strategy):
    left, right = spark.createDataFrame(LEFT, SCHEMA), spark.createDataFrame(RIGHT, SCHEMA)
    out = diff(left, right, DiffConfig(["id"]), strategy)
    assert rows(out.added) == [(5, "eve", 50.0)]
    assert rows(out.removed) == [(4, "dave", 40.0)]
    assert [tuple(r) for r in out.changed.collect()] == [(2, ["value"], "bob", "bob", 20.0, 25.0)]
    assert out.changed.columns == ["id", "changed_columns", "left_name", "right_name", "left_value", "right_value"]
    s = out.summary()
    assert (s.added, s.removed, s.changed) == (1, 1, 1)


def test_same_table(spark, strategy):
    df = spark.createDataFrame(LEFT, SCHEMA)
    s = diff(df, df, DiffConfig(["id"]), strategy).summary()
    assert (s.added, s.removed, s.changed) == (0, 0, 0)


def test_explicit_columns(spark, strategy):
    left = spark.createDataFrame(LEFT, SCHEMA)
    right = left.withColumn("name", F.when(F.col("id") == 2, "BOB").otherwise(F.col("name")))
    assert diff(left, right, DiffConfig(["id"], ["value"]), strategy).summary().changed == 0
    assert diff(left, right, DiffConfig(["id"], ["name"]), strategy).summary().changed == 1


def test_limit_keeps_counts(spark, strategy):
    left = spark.createDataFrame([(1, "a")], "id int, name string")
    right = spark.range(1, 51).select(F.col("id").cast("int").alias("id"), F.lit("a").alias("name"))
    out = diff(left, right, DiffConfig(["id"], limit=5), strategy)
    assert out.summary().added == 49
    assert [r["id"] for r in out.added.collect()] == [2, 3, 4, 5, 6]


def test_nulls(spark, strategy):
    left = spark.createDataFrame([(1, None, None), (2, None, 1.0), (3, "c", None), (None, "k", 1.0)], SCHEMA)
    right = spark.createDataFrame([(1, None, None), (2, "b", 1.0), (3, "c", None), (None, "k", 2.0)], SCHEMA)
    out = diff(left, right, DiffConfig(["id"]), strategy)
    assert sorted((r["id"], tuple(r["changed_columns"])) for r in out.changed.collect() if r["id"]) == [(2, ("name",))]
    assert [tuple(r["changed_columns"]) for r in out.changed.collect() if r["id"] is None] == [("value",)]
    s = out.summary()
    assert (s.added, s.removed, s.changed) == (0, 0, 2)


def test_composite_key_and_several_columns(spark, strategy):
    schema = "id int, region string, value int, tag string"
    left = spark.createDataFrame([(1, "eu", 1, "x"), (1, "us", 2, "x"), (2, "eu", 3, "x")], schema)
    right = spark.createDataFrame([(1, "eu", 9, "y"), (1, "us", 2, "x"), (3, "eu", 3, "x")], schema)
    out = diff(left, right, DiffConfig(["id", "region"]), strategy)
    assert [(r["id"], r["region"], r["changed_columns"]) for r in out.changed.collect()] == [(1, "eu", ["value", "tag"])]
    s = out.summary()
    assert (s.added, s.removed, s.changed) == (1, 1, 1)


def test_duplicate_keys_agree(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    right = spark.createDataFrame([(1, "a"), (1, "z"), (2, "c")], "id int, v string")
    got = {s: rows(diff(left, right, DiffConfig(["id"], limit=None), s).changed) for s in STRATEGIES}
    assert got["full"] == got["hash"] == got["bloom"] and len(got["full"]) == 3


def test_microseconds(spark, strategy):
    left = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ'2024-01-01 00:00:00.000001' AS ts")
    right = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ'2024-01-01 00:00:00.000002' AS ts")
    assert diff(left, right, DiffConfig(["id"]), strategy).summary().changed == 1


def test_filters_keep_rows_out_of_joins(spark, monkeypatch):
    """Keys of one side only don't reach the anti-join; without filters the rows are the same."""
    left, right = spark.range(2000).withColumn("v", F.lit(1)), spark.range(1990, 4000).withColumn("v", F.lit(2))
    out = diff(left, right, DiffConfig(["id"], limit=None), "bloom")
    assert "might_contain" in out.added._jdf.queryExecution().executedPlan().toString()
    got = out.summary()
    monkeypatch.setattr("keelson.operators.diff.FILTER_KEYS", 10)
    plain = diff(left, right, DiffConfig(["id"], limit=None), "bloom")
    assert "might_contain" not in plain.added._jdf.queryExecution().executedPlan().toString()
    assert (got.added, got.removed, got.changed) == (plain.summary().added, plain.summary().removed, plain.summary().changed) == (2000, 1990, 10)


def test_negative_zero_and_nested_values(spark, strategy):
    """0.0 and -0.0 are one value, also inside arrays; NaN is itself."""
    left = spark.sql("SELECT 1 AS id, 0D AS v, array(0D) AS w, double('NaN') AS x UNION ALL SELECT 2, 1D, array(1D, NULL), 5D")
    right = spark.sql("SELECT 1 AS id, -0D AS v, array(-0D) AS w, double('NaN') AS x UNION ALL SELECT 2, 1D, array(1D, 2D), 5D")
    assert diff(left, right, DiffConfig(["id"], ["v", "x"]), strategy).summary().changed == 0
    out = diff(left, right, DiffConfig(["id"]), strategy)
    assert [(r["id"], r["changed_columns"]) for r in out.changed.collect()] == [(2, ["w"])] and out.summary().changed == 1


def test_all_key_and_odd_names(spark, strategy):
    left = spark.createDataFrame([(1, 2), (3, 4)], "`a.b` int, `c d` int")
    right = spark.createDataFrame([(1, 2), (5, 6)], "`a.b` int, `c d` int")
    s = diff(left, right, DiffConfig(["a.b", "c d"]), strategy).summary()
    assert (s.added, s.removed, s.changed) == (1, 1, 0)
    out = diff(left, right.withColumn("c d", F.lit(7)), DiffConfig(["a.b"]), strategy)
    assert out.changed.columns == ["a.b", "changed_columns", "left_c d", "right_c d"]


def test_invalid(spark):
    df = spark.createDataFrame(LEFT, SCHEMA)
    for config in (DiffConfig(["nope"]), DiffConfig(["id"], ["nope"])):
        with pytest.raises(ValueError, match="missing"):
            diff(df, df, config)
    with pytest.raises(ValueError, match="key id"):
        diff(df, df.withColumn("id", F.col("id").cast("long")), DiffConfig(["id"]))
    with pytest.raises(ValueError, match="missing on the right"):
        diff(df, df.drop("value"), DiffConfig(["id"]))
    for bad in (dict(keys=[]), dict(keys=["id"], limit=0)):
        with pytest.raises(ValueError):
            DiffConfig(**bad)
    with pytest.raises(ValueError, match="unknown strategy"):
        diff(df, df, DiffConfig(["id"]), "magic")


TABLE = st.dictionaries(st.one_of(st.none(), st.integers(0, 6)), st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.sampled_from(["x", "y", None])), max_size=7)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TABLE, TABLE)
def test_against_dictionaries(spark, a, b):
    frame = lambda t: spark.createDataFrame([(k, *v) for k, v in t.items()], "id int, v int, w string")
    changed = sorted(str(k) for k in a.keys() & b.keys() if a[k] != b[k])
    for strategy in STRATEGIES:
        out = diff(frame(a), frame(b), DiffConfig(["id"], limit=None), strategy)
        assert sorted(str(r["id"]) for r in out.added.collect()) == sorted(map(str, b.keys() - a.keys()))
        assert sorted(str(r["id"]) for r in out.removed.collect()) == sorted(map(str, a.keys() - b.keys()))
        assert sorted(str(r["id"]) for r in out.changed.collect()) == changed


def test_filters_are_no_literals(spark):
    """Filters are subqueries: as literals, each plan that is printed, and the driver holds, had all their bytes as hex."""
    left, right = spark.range(50_000).withColumn("v", F.lit(1)), spark.range(40_000, 90_000).withColumn("v", F.lit(2))
    out = diff(left, right, DiffConfig(["id"], limit=None), "bloom")
    for frame, n in ((out.added, 40_000), (out.removed, 40_000)):
        plan = frame._jdf.queryExecution().toString()
        assert "might_contain" in plan and len(plan) < 50_000
        assert frame.count() == n


def test_bloom_counts_in_one_join(spark):
    """Each stage that asks a filter has a copy in the driver; null and repeated keys count as in the other strategies."""
    left = spark.createDataFrame([(None, 1), (1, 1), (1, 2), (2, 1), (3, 1)], "id int, v int")
    right = spark.createDataFrame([(None, 2), (1, 1), (3, 1), (4, 1), (4, 2)], "id int, v int")
    got = {s: diff(left, right, DiffConfig(["id"]), s).counts for s in STRATEGIES}
    assert rows(got["bloom"]) == rows(got["full"]) == rows(got["hash"]) == [(2, 1, 2)]
    plan = got["bloom"]._jdf.queryExecution().optimizedPlan().toString().split("Subquery")[0]
    assert plan.count("Join ") == 1
