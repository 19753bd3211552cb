"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame operations only).

The documents of a source are shuffled (by a hash) into one stream of words, which is cut into blocks of equal size. Slot n
of the mix is point n of a golden-ratio sequence; mapped through the cumulative weights it names a source, and its rank
among that source's slots names the block. So any prefix of the mix is close to the target weights.

Ranks and offsets are prefix sums in two levels (over buckets, then inside them): no window holds a whole source.

Defined cases: null text has size 0; a very long text goes through as many blocks as it covers; documents without words are never taken; a null source is one source, last in
order; repeated rows are documents of their own; an empty table, or one without words, takes nothing; other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import attach, materialize, with_key, word_count

WEIGHTS = (1, 2, 3)
CAP = 3
#: The golden ratio's fraction of 2**31, odd: multiples of it modulo 2**31 are the points.
POINTS, STEP = 1 << 31, 1327217885
#: Rows in a bucket of the first level, about; slots in one.
BUCKET_ROWS, SLOT_ROWS = 2048, 1024
#: Words in a block.
BLOCK = 4096
CELL_BITS = 10


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source: source, sid (order by code point, null last), source_size, n_docs, target.

    Target: the share by weight of all words, at most `cap` times the source's size; the excess is shared by weight among
    the others until none is above. In order of size by weight, the level at which water stands if all before a source are
    full rises up to the first that isn't full and falls after it: the greatest of them is that fixed point.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("most") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return per.withColumn("target", F.least("most", F.col("level") * F.col("w"))).drop("w", "most", "level")


def schedule(sources: DataFrame, n_slots: int, block: int, cap: int = CAP) -> DataFrame:
    """sid, block, times: how often the slots of the schedule take each block of each source, at most `cap` times.

    sources: sid, source_size, target, and perhaps `needed`, the number of slots that each source is to have.
    """
    spark = sources.sparkSession
    share = Window.orderBy("sid")
    total = F.sum("target").over(Window.partitionBy())
    edge = F.floor(F.sum("target").over(share) / total * POINTS)
    cuts = sources.where("target > 0").withColumn("hi", edge.cast("long")).withColumn("lo", F.lag("hi", 1, 0).over(share))
    shift = 31 - CELL_BITS
    cuts = cuts.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))))
    n_blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    cuts = cuts.select("sid", "lo", "hi", "cell", n_blocks.alias("n_blocks"))
    slots = spark.range(n_slots).withColumn("u", F.pmod(F.pmod("id", F.lit(POINTS)) * F.lit(STEP), F.lit(POINTS)))
    slots = slots.withColumn("cell", F.shiftright("u", shift)).join(cuts, "cell").where("u >= lo AND u < hi")
    slots = slots.withColumn("chunk", F.floor(F.col("id") / F.lit(SLOT_ROWS)))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = slots.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("id")) - 1
    ranked = slots.withColumn("rank", rank).join(firsts, ["sid", "chunk"]).withColumn("rank", F.col("rank") + F.col("first"))
    taken = ranked.select("sid", "rank", "n_blocks")
    if "needed" in sources.columns:
        had = taken.groupBy("sid").agg(F.count(F.lit(1)).alias("had"))
        short = sources.select("sid", "needed", n_blocks.alias("n_blocks")).join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0)))
        # Discrepancy leaves a source a few slots short, if any.
        more = short.where("had < needed").select("sid", F.explode(F.sequence(F.col("had"), F.col("needed") - 1)).alias("rank"), "n_blocks")
        taken = taken.join(sources.select("sid", "needed"), "sid").where("rank < needed").drop("needed").union(more)
    taken = taken.where(F.col("rank") < F.col("n_blocks") * cap).withColumn("block", F.pmod("rank", "n_blocks"))
    return taken.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))


def _offsets(rows: DataFrame, n_docs: int) -> DataFrame:
    """Add `start`: the words before a document in its source's shuffled stream."""
    bits = max(0, (max(1, n_docs) // BUCKET_ROWS).bit_length())
    bucket: Column = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("bucket", bucket)
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(bases, ["sid", "bucket"]).withColumn("start", F.col("start") + F.col("base"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, copies, and the key of the row (`_kid`, `_kh`).

    taken: words of the document that the mix takes, repeats counted. copies: how often it takes the block in which the
    document starts, for mixes of whole documents. block: words in a block.
    """
    rows = with_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source")), "id", "text")
    h = F.xxhash64(F.lit(seed), "id", "_kh")
    sized = materialize(rows.select("id", "source", "_kid", "_kh", word_count(F.col("text")).alias("size"), h.alias("h"), F.monotonically_increasing_id().alias("row")), "mix-sizes")
    sources = materialize(targets(sized, weights, cap), "mix-sources")
    total, n_docs = (x or 0 for x in sources.agg(F.sum("source_size"), F.sum("n_docs")).first())
    # A source's words, as often as it is taken whole, and the rest, in slots of which the last is cut.
    rest = F.when(F.col("source_size") > 0, F.col("quota") % F.col("source_size")).otherwise(F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0))
    filled = sources.withColumn("quota", F.round("target").cast("long")).withColumn("rest", rest.cast("long"))
    filled = filled.withColumn("needed", (whole * F.ceil(F.col("source_size") / F.lit(block)) + F.ceil(F.col("rest") / F.lit(block))).cast("long"))
    times = schedule(filled, -(-total // block), block, cap)
    rows = sized.alias("a").join(filled.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.sid", "b.source_size", "b.target", "b.rest")
    rows = _offsets(rows, n_docs)
    end, size = F.col("start") + F.col("size"), F.lit(block)
    first, last = F.floor(F.col("start") / size), F.floor((end - 1) / size)
    cut = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    overlap = F.least(end, (F.col("block") + 1) * size) - F.greatest(F.col("start"), F.col("block") * size)
    # The words of the last slot beyond the rest aren't taken.
    beyond = F.greatest(F.lit(0), F.least(end, (F.col("block") + 1) * size) - F.greatest(F.col("start"), F.col("rest")))
    beyond = F.when((F.col("rest") > F.col("block") * size) & (F.col("rest") < (F.col("block") + 1) * size), beyond).otherwise(F.lit(0))
    cut = cut.withColumn("words", overlap).withColumn("beyond", beyond).withColumn("head", F.col("block") == first)
    cut = cut.join(times, ["sid", "block"], "left")
    out = cut.groupBy("row", "id", "source", "_kid", "_kh", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("words") * F.col("times") - F.col("beyond")), F.lit(0)).cast("long").alias("taken"),
        F.coalesce(F.max(F.when(F.col("head"), F.col("times") - (F.col("beyond") >= F.col("words")).cast("int"))), F.lit(0)).cast("long").alias("copies"),
    )
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken", "copies", "_kid", "_kh")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix of whole documents: each row of `docs` as often as the schedule takes the block in which it starts."""
    found = mix(docs, weights, cap, id_col=id_col, text_col=text_col, source_col=source_col)
    out = attach(docs, found.select("_kid", "_kh", "copies"), "copies", id_col, text_col).where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
