"""Joins that spread the rows of hot keys over several reducers.

Rows of the skewed side get a salt, those of the other side a copy for every salt; both only for hot keys. The salt comes
from a hash of the row's values alone, so a task that runs again, on rows in another order, gives the same rows; equal rows
share a salt. Rows with null or cold keys keep salt 0, in the same projection. Outer joins may only preserve the salted side: copies of the other side would be padded once each.
So where an outer join preserves the other side, the matches are a salted inner join, and rows without any are added by an anti-join with the distinct keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ...functions.columns import all_of, any_of, name
from .skew import hot_keys

SALT = "__keelson_salt"
TYPES = {"inner": "inner", "left": "left", "left_outer": "left", "leftouter": "left", "right": "right", "right_outer": "right", "rightouter": "right"}


@dataclass(frozen=True)
class AutoSaltConfig:
    """side: auto (the side with more hot keys; the left on a tie), left or right."""

    sample_fraction: float = 0.01
    multiplier: float = 10.0
    min_hot_key_count: int = 100
    salt_factor: int = 10
    max_skewed_keys: int = 1000
    seed: int = 42
    side: str = "auto"
    cache_result: bool = True

    def __post_init__(self) -> None:
        if not 0 < self.sample_fraction <= 1:
            raise ValueError("sample_fraction must be above 0 and at most 1")
        if self.multiplier <= 1:
            raise ValueError("multiplier must be above 1")
        if self.salt_factor < 2:
            raise ValueError("salt_factor must be at least 2")
        if self.side not in ("auto", "left", "right"):
            raise ValueError("side must be auto, left or right")


def _is_hot(keys: Sequence[str], hot: Sequence[Row] | None) -> Column:
    """hot: rows of key values; None makes every row hot. Null keys give false."""
    if hot is None:
        return F.lit(True)
    columns = [F.col(name(k)) for k in keys]
    if len(columns) == 1:
        return F.coalesce(columns[0].isin([r[0] for r in hot]), F.lit(False))
    return F.coalesce(any_of(all_of(c == F.lit(v) for c, v in zip(columns, r, strict=False)) for r in hot), F.lit(False))


def value_salt(df: DataFrame, n: int) -> Column:
    """0 to n - 1, by a hash of the row's values (of all but maps, which can't be hashed)."""
    return F.pmod(F.xxhash64(F.lit(SALT), *[F.col(name(c)) for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]), F.lit(n))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salt_factor: int = 10, hot: Sequence[Row] | None = None, side: str = "left") -> DataFrame:
    """Join with `side` salted. hot: the key values to spread; None spreads all."""
    kind = TYPES.get(how.lower())
    if kind is None:
        raise ValueError(f"a salted join can't do {how} joins; it can do inner, left_outer and right_outer")
    if kind not in ("inner", side):
        raise ValueError(f"a {how} join can only be salted on the side that it preserves")
    keys = list(keys)

    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn(SALT, F.when(_is_hot(keys, hot), value_salt(df, salt_factor)).otherwise(F.lit(0)).cast("int"))

    def repeat(df: DataFrame) -> DataFrame:
        every, one = F.sequence(F.lit(0), F.lit(salt_factor - 1)), F.array(F.lit(0))
        return df.withColumn(SALT, F.explode(F.when(_is_hot(keys, hot), every).otherwise(one)))

    left, right = (spread(left), repeat(right)) if side == "left" else (repeat(left), spread(right))
    return left.join(right, [*keys, SALT], kind).drop(SALT)


def _padded_join(left: DataFrame, right: DataFrame, keys: Sequence[str], kind: str, salt_factor: int, hot: Sequence[Row], side: str) -> DataFrame:
    """A left or right join that preserves the side that isn't salted."""
    matches = salted_join(left, right, keys, "inner", salt_factor, hot, side)
    kept, other = (left, right) if kind == "left" else (right, left)
    alone = kept.join(other.select(*[name(k) for k in keys]).distinct(), list(keys), "left_anti")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema if f.name not in keys]
    own = [F.col(name(c)) for c in kept.columns if c not in keys]
    return matches.union(alone.select(*[F.col(name(k)) for k in keys], *(own + none if kind == "left" else none + own)))


def auto_salt_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", config: AutoSaltConfig | None = None) -> DataFrame:
    """Find hot keys and spread them; a plain join where there are none."""
    config = config or AutoSaltConfig()
    kind = TYPES.get(how.lower())
    if kind is None:
        raise ValueError(f"an auto-salted join can't do {how} joins; it can do inner, left_outer and right_outer")

    def find(df: DataFrame) -> list[Row]:
        # At most max_skewed_keys rows come to the driver.
        return hot_keys(df, keys, config.sample_fraction, config.multiplier, config.min_hot_key_count, config.max_skewed_keys, config.seed).select(*[name(k) for k in keys]).collect()

    found = {side: find(df) for side, df in (("left", left), ("right", right)) if config.side in ("auto", side)}
    side = max(found, key=lambda s: (len(found[s]), s == "left"))
    if not found[side]:
        out = left.join(right, list(keys), kind)
    elif kind not in ("inner", side):
        out = _padded_join(left, right, keys, kind, config.salt_factor, found[side], side)
    else:
        out = salted_join(left, right, keys, kind, config.salt_factor, found[side], side)
    return out.cache() if config.cache_result else out
