"""A join that falls back from one strategy to the next."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ...config import MIB, ResilientSettings
from ...plans.internals import SPARK_ERRORS, size_in_bytes
from .strategies import BroadcastStrategy, FailureContext, JoinStrategy, RepartitionStrategy, ShuffledHashStrategy, SortMergeStrategy, is_memory_failure


class ResilientJoinExhausted(RuntimeError):
    """Every strategy failed or declined; `contexts` has the failures in order."""

    def __init__(self, contexts: Sequence[FailureContext]):
        self.contexts = list(contexts)
        super().__init__("no join strategy succeeded: " + (" → ".join(f"{c.strategy} ({type(c.error).__name__})" for c in contexts) or "all declined"))


@dataclass(frozen=True)
class JoinConfig:
    """strategies: tried in order (default: broadcast, sort-merge, repartition). cache: keep a successful result in memory;
    the caller unpersists it. validate: `probe` runs the join as far as its first row, `full` counts all rows (into the
    cache, if `cache`), `none` only plans it."""

    strategies: Sequence[JoinStrategy] | None = None
    broadcast_threshold_bytes: int = 100 * MIB
    cache: bool = True
    max_attempts: int = 3
    validate: str = "probe"

    def chain(self) -> list[JoinStrategy]:
        if self.strategies is not None:
            return list(self.strategies)
        return [BroadcastStrategy(self.broadcast_threshold_bytes), SortMergeStrategy(), RepartitionStrategy()]


def resilient_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", config: JoinConfig | None = None, only_memory: bool = False) -> DataFrame:
    """Join by the first strategy that works. only_memory: pass on failures that more memory wouldn't mend."""
    return _run(left, right, keys, how, config or JoinConfig(), only_memory)[0]


def _run(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, config: JoinConfig, only_memory: bool = False) -> tuple[DataFrame, str]:
    sizes = size_in_bytes(left), size_in_bytes(right)
    failures: list[FailureContext] = []
    for strategy in config.chain():
        if len(failures) >= config.max_attempts:
            break
        previous = failures[-1] if failures else None
        if not strategy.can_handle(left, right, how, previous):
            continue
        cached = None
        try:
            out = strategy.join(left, right, keys, how, previous)
            if config.cache and config.validate != "none":
                out = cached = out.cache()
            if config.validate == "full":
                out.count()
            elif config.validate == "probe":
                out.isEmpty()
            return out, strategy.name
        except (*SPARK_ERRORS, RuntimeError, MemoryError) as error:
            if cached is not None:
                cached.unpersist()
            if only_memory and not is_memory_failure(error):
                raise
            failures.append(FailureContext(strategy.name, error, len(failures) + 1, *sizes))
    raise ResilientJoinExhausted(failures) from (failures[-1].error if failures else None)


@dataclass(frozen=True)
class EngineJoin:
    """The result of an engine-level join and the strategy that made it."""

    result: DataFrame
    strategy: str


def engine_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", settings: ResilientSettings | None = None) -> EngineJoin:
    """Broadcast, then shuffled hash, then sort-merge; only memory failures lead on.

    With the mode disabled it is a plain join. Joins without a side that may be built (full outer) skip the broadcast.
    """
    settings = settings or ResilientSettings.from_spark(left.sparkSession)
    if not settings.enabled:
        return EngineJoin(left.join(right, list(keys), how), "plain")
    chain = [BroadcastStrategy(settings.broadcast_threshold), ShuffledHashStrategy(), SortMergeStrategy()]
    return EngineJoin(*_run(left, right, keys, how, JoinConfig(chain, cache=False), only_memory=True))


#: What `enable_engine` sets: run-time re-planning, skew handling, and hash joins where partitions turn out small.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.keelson.resilientJoin.enabled": "true",
}


def enable_engine(spark) -> None:
    """Turn on the engine-level mode for a session: Spark then picks and changes join strategies at run time."""
    for key, value in ENGINE_CONF.items():
        spark.conf.set(key, value)
