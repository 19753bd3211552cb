"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.internals import size_in_bytes

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or one of our own where that is unset and all is on one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="keelson-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors.

    `discard` removes a table that nothing will read again, `clean_up` all of an application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keelson/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.keelson_path = path
    return out


#: Bytes of a row group of `materialize_arrow`.
ROW_GROUP = 8 << 20


def _to_file(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], folder: str):
    """Write what `run` makes of a task's rows to a file of the task. Of attempts at a task, the first that ends has its file there."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}"
        own = f"{folder}/_{name}-{context.taskAttemptId()}"  # readers skip it
        sink, held, size, rows = None, [], 0, 0

        def put() -> None:
            nonlocal sink, held, size
            sink = sink or pq.ParquetWriter(own, held[0].schema, compression="zstd", compression_level=3, use_dictionary=False, write_statistics=False)
            sink.write_table(pa.Table.from_batches(held))
            held, size = [], 0

        try:
            for batch in run(batches):
                if batch.num_rows:
                    held.append(batch)
                    rows += batch.num_rows
                    size += batch.nbytes
                if size >= ROW_GROUP:
                    put()
            if held:
                put()
            if sink:
                sink.close()
                with suppress(FileExistsError):
                    os.link(own, f"{folder}/{name}.parquet")
        finally:
            if sink:
                sink.close()
                os.unlink(own)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    return write


def _own_folder(spark: SparkSession) -> str | None:
    """The shared folder, where it is a path that tasks can write files to by themselves."""
    folder = re.fullmatch(r"file:(?://)?(/[^/].*)", shared_dir(spark))
    return folder and folder[1]


def materialize_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, label: str) -> DataFrame:
    """`materialize` of `df.mapInArrow(run, schema)`. Where the shared folder is a path, tasks write their files themselves.

    Without its native library, Hadoop starts a `chmod` for each file and folder that it makes in a path, and until that runs, the
    child is a second view of the executor's whole memory. What `run` makes doesn't travel back to the JVM, either.
    """
    spark = df.sparkSession
    folder = _own_folder(spark)
    if not folder:
        return materialize(df.mapInArrow(run, schema), label)
    at = f"/keelson/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    os.makedirs(folder + at)
    df.mapInArrow(_to_file(run, folder + at), "rows bigint").collect()
    out = spark.read.schema(schema).parquet(f"file://{folder}{at}")
    out.keelson_path = f"file://{folder}{at}"
    return out


def _as_they_are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches


def materialize_rows(df: DataFrame, label: str) -> DataFrame:
    """`materialize`, with files written as by `materialize_arrow`. For operators that may run Python on the executors."""
    if not _own_folder(df.sparkSession):
        return materialize(df, label)
    return materialize_arrow(df, _as_they_are, df.schema, label)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables. No frame that is still to be evaluated may depend on them."""
    for df in tables:
        if path := getattr(df, "keelson_path", None):
            _delete(df.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Remove all tables that this application has materialized, once its results are written."""
    _delete(spark, f"{shared_dir(spark)}/keelson/{spark.sparkContext.applicationId}")


def release(spark: SparkSession) -> None:
    """Have the files of shuffles that nothing refers to any more removed now, rather than when the driver runs out of memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """About how many bytes of text there are: twice the files' size, as these are compressed, or else a count."""
    estimate = 2 * size_in_bytes(docs)
    if estimate < 1 << 50:
        return estimate
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def width_for(spark: SparkSession, volume: int, most: int = 64 << 20) -> int:
    """How many partitions to deal `volume` bytes to by a key: the shuffle partitions, or more if these would hold over `most`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(volume) // most))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII rows take the fast path, for which `lower` does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(id_: Column, text: Column) -> list[Column]:
    """`_kid`, `_kh`: a key of a row by its content, null-safe; only repeated rows share it."""
    return [F.coalesce(id_.cast("string"), F.lit("null")).alias("_kid"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_kh")]


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add the key of each row. For selections of the operators' own, whose names don't clash."""
    return docs.select("*", *_key(F.col(id_col), F.col(text_col)))


def attach(docs: DataFrame, decisions: DataFrame, value: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc` (a row of `docs`, as a struct, so that no name can clash) with its own `value` in `decisions` (`_kid`, `_kh`, value).

    Rows without a decision are dropped. Repeated rows (of one id and text) get one value each. Neither side relies on row
    numbers of an earlier scan, which change when the cluster does. Where repeated rows differ in their values, equal ones are
    counted before they meet, so that however many there are make one row.
    """
    key = ["_kid", "_kh"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_key(F.col(id_col), F.col(text_col)))
    entries = decisions.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    per_key = materialize(entries.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(value, "n")), asc=False).alias("values")), "decisions")
    both = rows.join(per_key.hint("merge"), key)
    alike = both.where(F.size("values") == 1).select("doc", F.col("values")[0][value].alias(value))
    if per_key.where(F.size("values") > 1).isEmpty():
        return alike
    counted = both.where(F.size("values") > 1).groupBy("doc", *key, "values").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*key).orderBy(F.xxhash64("doc")).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # Value number i goes to the rows from upto(i - 1) to upto(i), in order.
    upto = "aggregate(slice(values, 1, i), 0L, (s, x) -> s + x.n)"
    share = F.expr(f"transform(values, (v, i) -> struct(v.{value} AS {value}, greatest(0L, least({upto} + v.n, `from` + n) - greatest({upto}, `from`)) AS times))")
    each = counted.select("doc", F.explode(share).alias("share")).where("share.times > 0")
    return alike.union(each.select("doc", F.col(f"share.{value}").alias(value), F.explode(F.sequence(F.lit(1).cast("long"), F.col("share.times")))).select("doc", value))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
