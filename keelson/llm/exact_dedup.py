"""Exact de-duplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest. New data is reduced to one row per digest, kept where a sort-merge
anti-join finds no entry, and appended, so that a batch shuffles only its own digests and never the index.

Defined cases: null text counts as empty; a very long text is one digest like any other; null ids lose against any other; of rows with equal text and id, one stays;
empty tables give empty results; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, attach, materialize, with_key

ENTRY = "text_sha256 string, keep_id {id}, keep_row long, batch string"


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, after lower-casing A-Z; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


class DigestIndex:
    """A persistent set of digests: table `name`, bucketed and sorted by `text_sha256`."""

    def __init__(self, spark: SparkSession, name: str, id_type: str = "bigint", buckets: int | None = None):
        """buckets: of a new index; by default as many as shuffle partitions, so that an append writes one file a bucket."""
        self.spark, self.name = spark, name
        if not spark.catalog.tableExists(name):
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._write(spark.createDataFrame([], ENTRY.format(id=id_type)))
        else:
            detail = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
            self.buckets = int(detail["Num Buckets"])

    def _write(self, rows: DataFrame) -> None:
        rows.repartition(self.buckets, "text_sha256").write.mode("append").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Append the new ones among `digests` (text_sha256, id, row); return the digests of this batch with the row that stays.

        Result: text_sha256, group_size (in this batch), keep_id, keep_row, new. A digest already in the index keeps its entry.
        batch: a name for these rows. A batch that is added again, say after a failure between its append and the use of its
        result, appends what is missing and gives the same result: its own entries count as new.
        """
        best = F.max(F.struct(F.col("id"), F.col("row"))).alias("best")
        groups = materialize(digests.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), best), "digest-groups")
        batch = batch or uuid.uuid4().hex
        fresh = groups.join(self.entries().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        self._write(fresh.select("text_sha256", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.lit(batch).alias("batch")))
        held = groups.join(self.entries().hint("merge"), "text_sha256")
        new = F.col("batch") == batch
        keep_id = F.when(new, F.col("best.id")).otherwise(F.col("keep_id"))
        return materialize(held.select("text_sha256", "group_size", keep_id.alias("keep_id"), F.col("best.row").alias("keep_row"), new.alias("new")), "digest-held")

    def compact(self) -> None:
        """Rewrite the table with one sorted file a bucket, as after its first append; batches leave one more each."""
        spare = f"{self.name}_compacted"
        self.spark.sql(f"DROP TABLE IF EXISTS {spare}")
        kept, self.name = self.name, spare
        try:
            self._write(self.spark.table(kept))
        finally:
            self.name = kept
        self.spark.sql(f"DROP TABLE {kept}")
        self.spark.sql(f"ALTER TABLE {spare} RENAME TO {kept}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256, and the key of the row (`_kid`, `_kh`).

    Without an index a fresh one is made for this call and dropped after it. batch: the name of these rows in the index; a call
    that is repeated after a failure must give the same name again.
    """
    spark = docs.sparkSession
    keyed = with_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    # The row numbers break ties between equal rows; they are fixed from here on.
    digests = materialize(keyed.select("id", "_kid", "_kh", digest(F.col("text")).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "digests")
    own = index is None
    if own:
        index = DigestIndex(spark, f"keelson_digests_{uuid.uuid4().hex}", dict(digests.dtypes)["id"])
    held = index.add(digests, batch)
    if own:
        index.drop()
    # Both sides are plain scans: adaptive execution can split the partition of a hot digest.
    out = digests.join(held.hint("merge"), "text_sha256")
    kept = F.col("new") & (F.col("row") == F.col("keep_row"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256", "_kid", "_kh")


def deduplicated(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    found = dedup(docs, index, id_col, text_col, batch)
    return attach(docs, found.select("_kid", "_kh", "kept"), "kept", id_col, text_col).where("kept").select("doc.*")
