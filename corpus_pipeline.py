"""A pipeline over `documents`: quality, exact and near copies, mixing, pieces. Each stage is a call of one operator.

Every stage but the last returns the columns of documents; the last returns doc_id, lang, source, n_pieces and pieces. The
mix holds a document as often as its schedule takes it, so the last result may repeat rows. Nulls, empty tables and extra
columns are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import exact_dedup, mixing, near_dedup, quality, sentencepiece_codec
from keelson.llm._common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.keep_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, 0.8), the document with the smallest id."""
    return near_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text."""
    row = docs.select(F.struct("doc_id", "lang", "source").alias("doc"), "text")
    return sentencepiece_codec.encode(row, id_col="doc").select("doc.*", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Outlier fits and signatures are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None
