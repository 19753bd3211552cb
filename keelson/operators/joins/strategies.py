"""Ways to run one equi-join, to be tried in turn."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from ...config import MIB
from ...functions.columns import name
from ...plans.internals import SPARK_ERRORS, error_texts, rows_in_bytes, size_in_bytes

#: What out-of-memory and broadcast failures look like.
MEMORY_TEXT = re.compile(r"outofmemory|\boom\b|oomkill|not enough memory to build and broadcast|cannot broadcast the table", re.I)
#: Join types whose given side may be the one that is broadcast or hashed.
BUILD_RIGHT = {"inner", "left", "left_outer", "leftouter", "left_semi", "leftsemi", "semi", "left_anti", "leftanti", "anti", "cross"}
BUILD_LEFT = {"inner", "right", "right_outer", "rightouter", "cross"}


def is_memory_failure(error: BaseException) -> bool:
    return any(MEMORY_TEXT.search(text) for text in error_texts(error))


@dataclass(frozen=True)
class FailureContext:
    """A strategy that failed: which, why, at which attempt (from 1), and the estimated sizes of both sides."""

    strategy: str
    error: BaseException
    attempt: int
    left_bytes: int
    right_bytes: int


class JoinStrategy(Protocol):
    name: str

    def can_handle(self, left: DataFrame, right: DataFrame, how: str, previous: FailureContext | None) -> bool:
        """Whether to try; a strategy that declines uses up no attempt."""

    def join(self, left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, previous: FailureContext | None) -> DataFrame: ...


def build_side(left: DataFrame, right: DataFrame, how: str) -> str | None:
    """The side to build a table of: the smaller one where the join type leaves a choice."""
    sides = [side for side, allowed in (("left", BUILD_LEFT), ("right", BUILD_RIGHT)) if how.lower() in allowed]
    if len(sides) < 2:
        return sides[0] if sides else None
    return "left" if size_in_bytes(left) < size_in_bytes(right) else "right"


def _hinted(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, hint: str, side: str | None) -> DataFrame:
    if side == "left":
        left = left.hint(hint)
    else:
        right = right.hint(hint)
    return left.join(right, list(keys), how)


def known_size(df: DataFrame) -> int:
    """The optimizer's estimate, or what the rows take at least, if that is more: an estimate by the size of compressed files
    may be a small part of it. Rows are counted, but those of an estimate too large for any broadcast only if it is a default."""
    size = size_in_bytes(df)
    if 8 << 30 < size < 1 << 50:
        return size
    rows = rows_in_bytes(df, df.count())
    return rows if size >= 1 << 50 else max(size, rows)


@dataclass(frozen=True)
class BroadcastStrategy:
    """Broadcast the side that may be built, if it is small enough by the estimate and by its rows."""

    threshold_bytes: int = 100 * MIB
    name: str = "broadcast"

    def can_handle(self, left: DataFrame, right: DataFrame, how: str, previous: FailureContext | None) -> bool:
        side = build_side(left, right, how)
        if side is None or (previous is not None and previous.strategy == self.name and is_memory_failure(previous.error)):
            return False
        built = left if side == "left" else right
        if size_in_bytes(built) > self.threshold_bytes:
            return False
        try:
            return known_size(built) <= self.threshold_bytes
        except SPARK_ERRORS:
            return True  # The join fails as well then, and its failure is recorded.

    def join(self, left, right, keys, how, previous):
        return _hinted(left, right, keys, how, "broadcast", build_side(left, right, how))


@dataclass(frozen=True)
class ShuffledHashStrategy:
    name: str = "shuffled_hash"

    def can_handle(self, left, right, how, previous) -> bool:
        return True

    def join(self, left, right, keys, how, previous):
        return _hinted(left, right, keys, how, "shuffle_hash", build_side(left, right, how))


@dataclass(frozen=True)
class SortMergeStrategy:
    name: str = "sort_merge"

    def can_handle(self, left, right, how, previous) -> bool:
        return True

    def join(self, left, right, keys, how, previous):
        return _hinted(left, right, keys, how, "merge", None)


@dataclass(frozen=True)
class RepartitionStrategy:
    """Deal both sides to more partitions first; twice as many after a memory failure."""

    base_partitions: int = 200
    name: str = "repartition"

    def partitions(self, previous: FailureContext | None) -> int:
        return self.base_partitions * (2 if previous is not None and is_memory_failure(previous.error) else 1)

    def can_handle(self, left, right, how, previous) -> bool:
        return True

    def join(self, left, right, keys, how, previous):
        n, columns = self.partitions(previous), [name(k) for k in keys]
        return left.repartition(n, *columns).join(right.repartition(n, *columns), list(keys), how)
