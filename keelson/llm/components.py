"""Connected components by large and small stars, each a grouping and a join; no vertex's neighbours meet in one row.

Up to `LOCAL` edges, a stated bound of 16 MB, are solved in one task, as a round of stars costs more than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize_arrow, materialize_rows

LOCAL = 1 << 20


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Link each vertex's neighbours (both: the larger ones, by way of all edges; else the smaller ones and itself) to the
    smallest of them and itself. edges: u > v."""
    to = edges.select("u", "v")
    if both:
        to = to.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = to.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    linked = to.join(least.hint("merge"), "u")
    if both:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # A vertex's link to the least comes with its edge to that.
    return linked.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each vertex has one edge down or several up, not both: then all edges lead to the smallest of a component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges to u, v: each vertex and the smallest that it reaches."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    ids, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    top = np.arange(len(ids))
    while True:
        low = np.minimum(top[a], top[b])
        new = top.copy()
        # Both ends, and what they are known to lead to, go to the lesser.
        for end in (a, b, top[a], top[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, top):
            break
        top = new
    own = np.flatnonzero(top != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[top[own]])], names=["u", "v"])


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """id, component for each vertex of `edges` (a, b: long) that isn't the smallest of its component.

    component: the smallest vertex that is reached. Loops and repeated edges do no harm.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = materialize_rows(edges.select(high.alias("u"), low.alias("v")).where("u > v"), label)
    if now.count() <= LOCAL:
        now = materialize_arrow(now.repartition(1), _solved, "u bigint, v bigint", label)
    else:
        now = materialize_rows(now.distinct(), label)
        while not _settled(now):
            now = materialize_rows(_stars(materialize_rows(_stars(now, True), label), False), label)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
