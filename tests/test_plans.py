import pytest
from pyspark.sql import functions as F

from keelson.plans.apply import apply_hints, hinted_sql, plan_fingerprint
from keelson.plans.compare import canonical, compare
from keelson.plans.hints import Broadcast, Coalesce, Rebalance, Repartition, Salt, SplitBroadcast, TargetedSalt, dedupe, parse
from keelson.plans.internals import executed_plan, formatted_plan
from keelson.plans.parser import parse_plan
from keelson.plans.sqltext import extract, fingerprint, normalized, rewrite

from .conftest import rows

ALL = [Broadcast(("a", "b")), Repartition(8), Coalesce(2), Rebalance(), SplitBroadcast("t", 4), Salt("t", 8), TargetedSalt("t", 8, ("1", "x y", "a|b", "c)d", 'q"', "e;f"))]


@pytest.mark.parametrize("hint", ALL, ids=lambda h: h.render().split("(")[0])
def test_round_trip(hint):
    assert parse(hint.render()) == hint and parse(hint.render().lower().replace("targeted_salt", "TARGETED_SALT")) is not None and hint.dataframe_call()


def test_parse_forms():
    assert parse("TARGETED_SALT(t, 4, 1|2)") == TargetedSalt("t", 4, ("1", "2")) == parse("targeted_salt(t,4,1,2)")
    for text in ("SALT(t)", "SALT", "REPARTITION(x)", "BROADCAST()", "NOPE(1)", "x y", ""):
        assert parse(text) is None


def test_dedupe_keeps_last_at_first_place():
    assert dedupe([Repartition(1), Broadcast(("a",)), Coalesce(3)]) == [Coalesce(3), Broadcast(("a",))]


@pytest.mark.parametrize(
    ("sql", "out"),
    [
        ("SELECT * FROM a", "SELECT /*+ REPARTITION(4) */ * FROM a"),
        ("WITH x AS (SELECT 1) SELECT * FROM x", "WITH x AS (SELECT 1) SELECT /*+ REPARTITION(4) */ * FROM x"),
        ("select /*+ BROADCAST(a, b), COALESCE(2) */ * from a", "select /*+ BROADCAST(a, b), REPARTITION(4) */ * from a"),
        ("-- SELECT\n/* SELECT */ SELECT 'SELECT ('", "-- SELECT\n/* SELECT */ SELECT /*+ REPARTITION(4) */ 'SELECT ('"),
        ("SHOW TABLES", "SHOW TABLES"),
        ("", ""),
    ],
)
def test_rewrite(sql, out):
    assert rewrite(sql, [Repartition(4)]) == out


def test_extract():
    assert extract("SELECT /*+ SALT(s, 4), BROADCAST(a) */ 1") == ("SELECT /*+ BROADCAST(a) */ 1", [Salt("s", 4)])
    assert extract("SELECT /*+ SALT(s, 4) */ 1") == ("SELECT 1", [Salt("s", 4)])
    assert extract("SELECT 1") == ("SELECT 1", [])


def test_text_fingerprint():
    assert normalized("SELECT  a -- c\n FROM t1 WHERE b = 'it''s' AND c > 1.5 ;") == "select a from t1 where b = ? and c > ?"
    assert fingerprint("select 1 from t") == fingerprint("SELECT 2\nFROM t;") != fingerprint("select 1 from u") and len(fingerprint("")) == 32


@pytest.fixture
def views(spark):
    spark.range(1, 1001).select(F.when(F.col("id") % 10 == 0, F.col("id") % 101).otherwise(0).cast("int").alias("k"), F.col("id").cast("string").alias("v")).createOrReplaceTempView("f")
    spark.range(101).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("n"), "id").alias("name")).createOrReplaceTempView("d")
    spark.sql("SELECT * FROM d UNION ALL SELECT * FROM d").createOrReplaceTempView("d_dup")


@pytest.mark.parametrize("hint", ["SPLIT_BROADCAST(d, 3)", "SALT(d, 4)", "TARGETED_SALT(d, 4, 0)", "SALT(f, 3)", "SPLIT_BROADCAST(f, 2)", "SPLIT_BROADCAST(d, 1)", "TARGETED_SALT(d, 4)", "SALT(nope, 4)"])
@pytest.mark.parametrize("dim", ["d", "d_dup"])
def test_hinted_sql_keeps_rows(spark, views, hint, dim):
    sql = f"SELECT {{}} f.v, d.name FROM f JOIN {dim} d ON f.k = d.k WHERE f.k < 90"
    assert rows(hinted_sql(spark, sql.format(f"/*+ {hint} */"))) == rows(spark.sql(sql.format("")))


def test_hints_by_join_type(spark, views):
    plan = lambda how, hint: executed_plan(hinted_sql(spark, f"SELECT /*+ {hint} */ count(*) FROM f {how} JOIN d ON f.k = d.k"))
    assert plan("", "SPLIT_BROADCAST(d, 3)").count("Union") and plan("LEFT SEMI", "SPLIT_BROADCAST(d, 3)").count("Union")
    assert not plan("LEFT", "SPLIT_BROADCAST(d, 3)").count("Union") and not plan("LEFT", "SALT(d, 3)").count("__keelson_salt")
    for how in ("LEFT", "RIGHT", "FULL", "LEFT SEMI", "LEFT ANTI"):
        sql = f"SELECT {{}} count(*) AS n FROM f {how} JOIN d ON f.k = d.k"
        assert rows(hinted_sql(spark, sql.format("/*+ SPLIT_BROADCAST(d, 3), SALT(f, 2) */"))) == rows(spark.sql(sql.format("")))


def test_apply_reports_what_fits(spark, views):
    df = spark.sql("SELECT f.v, d.name FROM f JOIN d ON f.k = d.k")
    out, applied = apply_hints(df, [Broadcast(("d",)), Salt("nope", 2), Repartition(3)])
    assert applied == [Broadcast(("d",)), Repartition(3)] and rows(out) == rows(df) and out.rdd.getNumPartitions() == 3
    assert rows(apply_hints(df, [Rebalance()])[0]) == rows(df)


def test_plan_fingerprint(spark, views):
    a, b, c = (plan_fingerprint(spark.sql(q)) for q in ("SELECT * FROM f WHERE k > 5", "SELECT * FROM f WHERE k > 77", "SELECT v FROM f WHERE k > 5"))
    assert a == b != c and len(a) == 32


def test_compare():
    assert canonical("+- *(12) Sort [a#1L]  plan_id=7") == canonical("+- *(3) Sort [a#9]  plan_id=8")
    before, after = "Join\n +- Exchange plan_id=1\n +- Scan a", "Join\n +- Scan a\n +- Scan b"
    assert [r[0] for r in compare(before, after)] == ["S", "D", "S", "A"]
    assert [r[0] for r in compare("a\nb", "a\nc")] == ["S", "C"] and compare("x\n" * 1300, "x") is None


def test_parser_counts_once(spark, views):
    df = spark.sql("SELECT /*+ MERGE(d) */ f.k, count(*) FROM f JOIN d ON f.k = d.k GROUP BY f.k ORDER BY f.k")
    tree, formatted = parse_plan(executed_plan(df)), parse_plan(formatted_plan(df))
    assert tree.joins == formatted.joins == ["SortMergeJoin"] and tree.adaptive and formatted.adaptive
    assert tree.exchanges == formatted.exchanges == 3 and tree.sorts == formatted.sorts
    assert parse_plan("") == parse_plan(None)


def test_parser_scans(spark, tmp_path):
    spark.range(10).withColumn("p", F.col("id") % 2).write.csv(str(tmp_path / "c"))
    spark.range(10).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(str(tmp_path / "q"))
    csv = spark.read.schema("id long, p long").csv(str(tmp_path / "c")).where("id > 3")
    plan = parse_plan(formatted_plan(csv.crossJoin(spark.read.parquet(str(tmp_path / "q")).where("p = 1").toDF("x", "y"))))
    by = {s.format: s for s in plan.scans}
    assert set(by) == {"csv", "parquet"} and by["csv"].pushed_filters and not by["csv"].partition_filters and by["parquet"].partition_filters and plan.cartesians
