"""Broadcast a side that is too large for one broadcast in several disjoint parts, and unite the joins."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...config import MIB
from ...functions.columns import bucket_of
from ...plans.internals import SPARK_ERRORS, driver_heap, error_texts
from .strategies import known_size

#: A row of the large side meets each part; so only types that neither pad nor reject by absence can be united.
TYPES = {"inner": "inner", "left_semi": "left_semi", "leftsemi": "left_semi", "semi": "left_semi", "cross": "cross"}
#: Sizes in messages of failed broadcasts, in this order.
SIZES = ((re.compile(r"(\d+(?:\.\d+)?)\s*bytes", re.I), 1), (re.compile(r"(\d+(?:\.\d+)?)\s*(?:GiB|GB)\b", re.I), 1 << 30), (re.compile(r"(\d+(?:\.\d+)?)\s*(?:MiB|MB)\b", re.I), 1 << 20), (re.compile(r"(\d+(?:\.\d+)?)\s*(?:KiB|KB)\b", re.I), 1 << 10))


#: All parts together may take one in so many of the driver's bytes; their hash tables take some three times their rows.
HEAP_SHARE = 4


class SplitBroadcastExhausted(RuntimeError):
    """More parts would be needed than allowed."""


@dataclass(frozen=True)
class SplitBroadcastConfig:
    """budget_bytes: of one broadcast. initial: parts to start with; None starts from the estimated size."""

    budget_bytes: int = 100 * MIB
    max_splits: int = 16
    cache_result: bool = True
    cache_large_side: bool = True
    initial: int | None = None


def parsed_size(error: BaseException) -> int | None:
    """The size of the table that couldn't be broadcast, if the messages down the cause chain tell."""
    for text in error_texts(error):
        for pattern, unit in SIZES:
            if found := pattern.search(text):
                return int(float(found[1]) * unit)
    return None


def next_splits(current: int, error: BaseException, budget_bytes: int) -> int:
    size = parsed_size(error)
    return current * 2 if size is None else max(math.ceil(size / budget_bytes), current * 2)


def split_join(large: DataFrame, small: DataFrame, keys: Sequence[str], how: str, splits: int) -> DataFrame:
    """The union of broadcast joins with `splits` disjoint parts of `small`.

    For left_semi a large row must match in one part only, which holds as equal keys share a part. The driver gathers all
    parts at once, however many they are: if `small` takes more than a HEAP_SHARE of its memory, parts by the same keys are
    dealt to tasks by a shuffle instead.
    """
    kind = TYPES.get(how.lower())
    if kind is None:
        raise ValueError(f"a split broadcast can't do {how} joins; it can do {', '.join(sorted(set(TYPES.values())))}")
    if known_size(small) > driver_heap(small.sparkSession) // HEAP_SHARE:
        return large.crossJoin(small.hint("shuffle_replicate_nl")) if kind == "cross" else large.join(small.hint("merge"), list(keys), kind)
    by = list(keys) or small.columns

    def part(i: int) -> DataFrame:
        own = F.broadcast(small if splits == 1 else small.where(bucket_of(by, splits) == i))
        return large.crossJoin(own) if kind == "cross" else large.join(own, list(keys), kind)

    return reduce(DataFrame.unionAll, [part(i) for i in range(splits)])


def split_broadcast_join(large: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", config: SplitBroadcastConfig | None = None) -> DataFrame:
    """Join by split broadcast, with more parts after each failure."""
    config = config or SplitBroadcastConfig()
    splits = config.initial or max(1, math.ceil(known_size(small) / config.budget_bytes))
    held = large.cache() if config.cache_large_side else large
    last: BaseException | None = None
    try:
        while splits <= config.max_splits:
            out = split_join(held, small, keys, how, splits)
            if config.cache_result:
                out = out.cache()
            try:
                out.isEmpty()
                return out
            except SPARK_ERRORS as error:
                if config.cache_result:
                    out.unpersist()
                last, splits = error, next_splits(splits, error, config.budget_bytes)
    finally:
        if config.cache_large_side:
            held.unpersist()
    raise SplitBroadcastExhausted(f"{splits} parts would be needed; at most {config.max_splits} are allowed") from last
