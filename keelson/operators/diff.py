"""What changed between two tables: added, removed and changed rows by key.

Keys compare null-safely in all three outputs. Three strategies give equal results:

* `full`: one full outer join of both tables; the choice when most rows differ.
* `hash`: both sides shrink to (keys, a 64-bit hash of the compared columns), and one full outer join of these says what is
  added, removed or may have changed. That is all that counts need; the changed rows are then joined whole, those keys only,
  and compared column by column.
* `bloom`: each side's keys make a Bloom filter (keys are counted when the diff is made, filters built as subqueries when it
  runs). What the other side's filter lacks exists on one side only, and is in no join; the rest is told apart by an anti-join
  on keys, and compared by an inner join. The choice when key sets differ much. Filters are built for up to `FILTER_KEYS` keys,
  8 MB each, else left out.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, any_of, flat, name, row_hash
from ..plans import internals as I

STRATEGIES = ("full", "hash", "bloom")
#: Most keys of a Bloom filter (Spark's own limits of bits then leave about a tenth of false positives), and bits of a key, for
#: a hundredth.
FILTER_KEYS, KEY_BITS = 10_000_000, 10


@dataclass(frozen=True)
class DiffConfig:
    """keys: columns that identify a row. columns: those compared (default: all others). limit: rows of each kind returned
    by `DiffResult`'s frames; None for all."""

    keys: Sequence[str]
    columns: Sequence[str] = field(default=())
    limit: int | None = 100

    def __post_init__(self) -> None:
        if not self.keys:
            raise ValueError("diff needs at least one key column")
        if self.limit is not None and self.limit <= 0:
            raise ValueError("the limit must be positive")


@dataclass(frozen=True)
class DiffSummary:
    added: int
    removed: int
    changed: int
    elapsed_ms: int


@dataclass(frozen=True)
class DiffResult:
    """added: whole rows of the right table. removed: whole rows of the left. changed: keys, changed_columns, then
    left_<c>, right_<c> for each compared column. counts: one row, lazily computed. summary: counts before the limit."""

    added: DataFrame
    removed: DataFrame
    changed: DataFrame
    counts: DataFrame

    def summary(self) -> DiffSummary:
        began = time.monotonic()
        row = self.counts.first()
        return DiffSummary(row["added"], row["removed"], row["changed"], int((time.monotonic() - began) * 1000))


def compared_columns(left: DataFrame, right: DataFrame, config: DiffConfig) -> list[str]:
    """The compared columns, after checks: they and the keys are on both sides, and key types agree."""
    columns = list(config.columns) or [c for c in left.columns if c not in config.keys]
    for side, df in (("left", left), ("right", right)):
        missing = [c for c in [*config.keys, *columns] if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing on the {side}: {', '.join(missing)}")
    for key in config.keys:
        a, b = left.schema[key].dataType, right.schema[key].dataType
        if a != b:
            raise ValueError(f"key {key} is {a.simpleString()} on the left and {b.simpleString()} on the right")
    return columns


def _sided(df: DataFrame, side: str, keys: Sequence[str]) -> DataFrame:
    """Keys as k0, k1 …, the other columns as <side>_<column>, and a flag <side>_here; each column once, so that a shuffle
    carries nothing twice and unused columns are pruned."""
    others = [F.col(name(c)).alias(f"{side}_{c}") for c in df.columns if c not in keys]
    return df.select(*[F.col(name(k)).alias(f"k{i}") for i, k in enumerate(keys)], *others, F.lit(True).alias(f"{side}_here"))


def _whole(df: DataFrame, side: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows of one side with their own names and order."""
    return df.select(*[F.col(f"k{list(keys).index(c)}" if c in keys else name(f"{side}_{c}")).alias(c) for c in columns])


def _differs(columns: Sequence[str]) -> list[Column]:
    return [~F.col(name(f"l_{c}")).eqNullSafe(F.col(name(f"r_{c}"))) for c in columns]


def _same_keys(a: DataFrame, b: DataFrame, n: int) -> Column:
    return all_of(a[f"k{i}"].eqNullSafe(b[f"k{i}"]) for i in range(n))


def _changed_rows(pairs: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    differs = _differs(columns)
    names = F.array_compact(F.array(*[F.when(d, F.lit(c)) for d, c in zip(differs, columns, strict=True)])) if columns else F.array().cast("array<string>")
    sides = [F.col(name(f"{side[0]}_{c}")).alias(f"{side}_{c}") for c in columns for side in ("left", "right")]
    return pairs.where(any_of(differs)).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], names.alias("changed_columns"), *sides)


def _limited(df: DataFrame, keys: Sequence[str], limit: int | None) -> DataFrame:
    """The first rows by key, so that a limit always returns the same ones."""
    return df if limit is None else df.orderBy(*[F.col(name(k)) for k in keys]).limit(limit)


def _key_filter(df: DataFrame, key_names: list[str]) -> Column | None:
    """Whether a row's keys may be among those of `df`; None where these are too many for a filter."""
    hashed = F.xxhash64(*key_names)
    items = df.count()
    if items > FILTER_KEYS:
        return None
    if not items:
        return F.lit(False)
    return I.might_contain(df.sparkSession, hashed, I.bloom_filter(df.select(hashed.alias("h")), "h", items, items * KEY_BITS))


def _both(a: DataFrame, b: DataFrame, key_names: list[str]) -> DataFrame:
    """The full outer join of both sides on their keys; a side that lacks a row has no flag."""
    others = [c for c in [*a.columns, *b.columns] if c not in key_names]
    # Keys go by names of their own: filters over one side's plan in the other's leave `a[k]` ambiguous.
    b = b.withColumnsRenamed({k: f"b{k}" for k in key_names})
    joined = a.join(b, all_of(F.col(k).eqNullSafe(F.col(f"b{k}")) for k in key_names), "full_outer")
    return joined.select(*[F.coalesce(k, f"b{k}").alias(k) for k in key_names], *[F.col(name(c)) for c in others])


def _counts(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All counts in one pass, in which columns that aren't compared are pruned."""
    only_right, only_left = F.col("l_here").isNull(), F.col("r_here").isNull()
    differs = ~only_right & ~only_left & any_of(_differs(columns))
    return both.agg(F.count_if(only_right).alias("added"), F.count_if(only_left).alias("removed"), F.count_if(differs).alias("changed"))


def _count(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("what"), "n")


def diff(left: DataFrame, right: DataFrame, config: DiffConfig, strategy: str = "full") -> DiffResult:
    """Compare two tables. Duplicate keys are compared pair by pair, like a join on the keys."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; there are {', '.join(STRATEGIES)}")
    columns, keys = compared_columns(left, right, config), list(config.keys)
    n = len(keys)
    a, b = _sided(left, "l", keys), _sided(right, "r", keys)
    key_names = [f"k{i}" for i in range(n)]
    if strategy == "full":
        both = _both(a, b, key_names)
        only_right, only_left = F.col("l_here").isNull(), F.col("r_here").isNull()
        added, removed = _whole(both.where(only_right), "r", keys, right.columns), _whole(both.where(only_left), "l", keys, left.columns)
        changed = _changed_rows(both.where(~only_right & ~only_left), keys, columns)
        counts = _counts(both, columns)
    else:
        alone_a = alone_b = None
        if strategy == "bloom":
            in_a, in_b = _key_filter(a, key_names), _key_filter(b, key_names)
            if in_a is not None and in_b is not None:
                alone_a, alone_b, a, b = a.where(~in_b), b.where(~in_a), a.where(in_b), b.where(in_a)
        ka, kb = a.select(key_names), b.select(key_names)
        added, removed = b.join(ka, _same_keys(b, ka, n), "left_anti"), a.join(kb, _same_keys(a, kb, n), "left_anti")
        if alone_a is not None:
            added, removed = added.union(alone_b), removed.union(alone_a)
        added, removed = _whole(added, "r", keys, right.columns), _whole(removed, "l", keys, left.columns)
        narrow = None
        if strategy == "hash" and columns:
            short = lambda df, h: df.select(*[F.col(name(k)).alias(f"k{i}") for i, k in enumerate(keys)], row_hash(df, columns).alias(h))
            ha, hb = short(left, "l_hash"), short(right, "r_hash")
            narrow = ha.join(hb, _same_keys(ha, hb, n), "full_outer").select(*[F.coalesce(ha[k], hb[k]).alias(f"s_{k}") for k in key_names], "l_hash", "r_hash")
            suspects = narrow.where("l_hash <> r_hash").select(*[f"s_{k}" for k in key_names]).distinct()
            pick = lambda df: df.join(suspects, all_of(df[k].eqNullSafe(suspects[f"s_{k}"]) for k in key_names), "left_semi")
            a, b = pick(a), pick(b)
        pairs = a.join(b, _same_keys(a, b, n)).select(*[a[k] for k in key_names], *[F.col(name(f"{s}_{c}")) for c in columns for s in "lr"])
        changed = _changed_rows(pairs, keys, columns)
        if alone_a is not None:
            # Each stage that asks a filter holds a copy of it in the driver: one join tells all three counts.
            zero = F.lit(0).cast("long")
            parts = _counts(_both(a, b, key_names), columns)
            parts = parts.union(alone_b.agg(F.count(F.lit(1)), zero, zero)).union(alone_a.agg(zero, F.count(F.lit(1)), zero))
            counts = parts.agg(*[F.sum(w).alias(w) for w in ("added", "removed", "changed")])
        elif narrow is not None and all(flat(left.schema[c].dataType) and left.schema[c].dataType == right.schema[c].dataType for c in columns):
            counts = narrow.agg(F.count_if(F.col("l_hash").isNull()).alias("added"), F.count_if(F.col("r_hash").isNull()).alias("removed"), F.count_if(F.col("l_hash") != F.col("r_hash")).alias("changed"))
        else:
            parts = _count(added, "added").union(_count(removed, "removed")).union(_count(changed, "changed"))
            counts = parts.agg(*[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("added", "removed", "changed")])
    return DiffResult(_limited(added, keys, config.limit), _limited(removed, keys, config.limit), _limited(changed, keys, config.limit), counts)
