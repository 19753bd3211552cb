"""The only module that touches Spark's JVM internals. Checked on Spark 4.x."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What failing Spark actions raise.
SPARK_ERRORS = (Py4JJavaError, PySparkException)


def supported(spark: SparkSession) -> bool:
    return int(spark.version.split(".")[0]) >= 4


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate; a very large default where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def rows_in_bytes(df: DataFrame, rows: int) -> int:
    """What so many rows take in memory at least; files, and so the optimizer's estimate, may be far smaller."""
    return rows * (16 + sum(max(8, f.dataType().defaultSize()) for f in df._jdf.schema().fields()))


def driver_heap(spark: SparkSession) -> int:
    return int(spark._jvm.java.lang.Runtime.getRuntime().maxMemory())


def executed_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().treeString()


def formatted_plan(df: DataFrame) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def canonical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().analyzed().canonicalized().toString()


def error_texts(error: BaseException) -> Iterator[str]:
    """Class names and messages down the cause chain, Python's and Java's."""
    seen: set[int] = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        yield f"{type(error).__name__}: {error}"
        java = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
        java = getattr(java, "java_exception", java) if isinstance(java, Py4JJavaError) else java
        depth = 0
        while java is not None and hasattr(java, "getMessage") and depth < 32:
            try:
                yield f"{java.getClass().getName()}: {java.getMessage()}"
                java, depth = java.getCause(), depth + 1
            except Py4JError:
                break
        error = error.__cause__ or error.__context__


# -- Logical plans as trees ---------------------------------------------------------------------------------------------


def analyzed(df: DataFrame):
    return df._jdf.queryExecution().analyzed()


def kind(node) -> str:
    return node.getClass().getSimpleName()


def children(node) -> list:
    found = node.children()
    return [found.apply(i) for i in range(found.size())]


def frame(spark: SparkSession, node) -> DataFrame:
    """A DataFrame of a logical plan; keeps the ids of its columns."""
    jdf = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node)
    return DataFrame(jdf, spark)


def column(spark: SparkSession, expression):
    from pyspark.sql.classic.column import Column as Classic

    return Classic(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def bloom_filter(df: DataFrame, name: str, items: int, bits: int) -> Column:
    """A Bloom filter of a column of longs, as a scalar subquery: Spark builds it by an aggregation when a query runs, and no
    plan holds its bytes (as a literal, each printed plan would have them all as hex). Null where there are no rows; larger
    than Spark's own limit (8 MB) it gets more false positives instead."""
    jvm = df.sparkSession._jvm.org.apache.spark.sql
    of = lambda c: jvm.classic.ExpressionUtils.expression(c._jc)
    long = lambda n: of(F.lit(n).cast("long"))
    made = jvm.catalyst.expressions.aggregate.BloomFilterAggregate(of(F.col(name)), long(items), long(bits))
    return df.agg(column(df.sparkSession, made.toAggregateExpression()).alias("filter")).scalar()


def might_contain(spark: SparkSession, value: Column, filter_: Column) -> Column:
    """Whether a filter may hold the value (a long), as Spark's own run-time filters ask; false for a filter of no rows."""
    jvm = spark._jvm.org.apache.spark.sql
    of = jvm.classic.ExpressionUtils.expression
    asked = column(spark, jvm.catalyst.expressions.BloomFilterMightContain(of(filter_._jc), of(value._jc)))
    return F.coalesce(asked, F.lit(False))


def with_children(spark: SparkSession, node, new: list):
    return node.withNewChildren(spark._jvm.PythonUtils.toSeq(new))


def conjuncts(expression) -> list:
    if kind(expression) == "And":
        return conjuncts(expression.left()) + conjuncts(expression.right())
    return [expression]


def resolves_on(expression, node) -> bool:
    """Whether all columns of an expression come from a plan."""
    return expression.references().subsetOf(node.outputSet())


def aliases(node) -> set[str]:
    """Names by which a join side can be meant: its sub-query aliases above any further join."""
    out: set[str] = set()
    if kind(node) == "SubqueryAlias":
        out.add(node.identifier().name().lower())
    if kind(node) != "Join":
        for child in children(node):
            out |= aliases(child)
    return out


# -- Status stores ------------------------------------------------------------------------------------------------------


def status_store(spark: SparkSession):
    return spark.sparkContext._jsc.sc().statusStore()


def sql_store(spark: SparkSession):
    return spark._jsparkSession.sharedState().statusStore()


def scala_list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def java_list(spark: SparkSession):
    return spark._jvm.java.util.ArrayList()


def doubles(spark: SparkSession, values: list[float]):
    out = spark.sparkContext._gateway.new_array(spark._jvm.double, len(values))
    for i, v in enumerate(values):
        out[i] = float(v)
    return out


def on_success(spark: SparkSession, callback) -> object:
    """Call `callback(function_name, query_execution, duration_ns)` after each successful query; returns the listener."""
    from pyspark.java_gateway import ensure_callback_server_started

    class Listener:
        def onSuccess(self, function_name, execution, duration_ns):  # noqa: N802
            callback(function_name, execution, duration_ns)

        def onFailure(self, function_name, execution, error):  # noqa: N802
            pass

        class Java:
            implements = ["org.apache.spark.sql.util.QueryExecutionListener"]

    ensure_callback_server_started(spark.sparkContext._gateway)
    listener = Listener()
    spark._jsparkSession.listenerManager().register(listener)
    return listener
