"""Settings, read from the Spark configuration under `spark.keelson.`; the suffixes and defaults are fixed values."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import SparkSession

PREFIX = "spark.keelson."
MIB = 1 << 20


def _set(suffix: str, default):
    return field(default=default, metadata={"suffix": suffix})


@dataclass(frozen=True)
class _Settings:
    @classmethod
    def keys(cls) -> dict[str, object]:
        """Every key with its default."""
        return {PREFIX + f.metadata["suffix"]: f.default for f in fields(cls)}

    @classmethod
    def from_mapping(cls, given: dict[str, str]):
        """Settings from strings by full key; what is missing or can't be read keeps its default."""
        out = {}
        for f in fields(cls):
            text = given.get(PREFIX + f.metadata["suffix"])
            if text is None:
                continue
            try:
                out[f.name] = text.strip().lower() == "true" if isinstance(f.default, bool) else type(f.default)(text)
            except ValueError:
                continue
        return cls(**out)

    @classmethod
    def from_spark(cls, spark: SparkSession):
        """The session's run-time settings over the application's."""
        given = dict(spark.sparkContext.getConf().getAll())
        for key in cls.keys():
            value = spark.conf.get(key, None)
            if value is not None:
                given[key] = value
        return cls.from_mapping(given)


@dataclass(frozen=True)
class IssueSettings(_Settings):
    skew_multiplier: float = _set("skewMultiplier", 3.0)
    gc_ratio: float = _set("gcRatioThreshold", 0.10)
    straggler_iqr_factor: float = _set("stragglerIQRFactor", 1.5)
    broadcast_size_mb: int = _set("broadcastSizeMB", 200)
    small_task_median_ms: int = _set("smallTaskMedianMs", 200)
    small_task_min_count: int = _set("smallTaskMinCount", 100)
    under_partition_ratio: float = _set("underPartitionRatio", 0.5)
    shuffle_amplify_ratio: float = _set("shuffleAmplifyRatio", 5.0)
    large_result_mb: int = _set("largeResultMB", 50)
    fetch_wait_ratio: float = _set("fetchWaitRatioThreshold", 0.2)
    high_deser_ms: int = _set("highDeserMs", 200)
    low_cpu_ratio: float = _set("lowCpuRatioThreshold", 0.5)
    low_cpu_min_run_ms: int = _set("lowCpuMinRunTimeMs", 60_000)
    disk_shuffle_read_min_mb: int = _set("diskShuffleReadMinMB", 100)
    high_scheduler_delay_ms: int = _set("highSchedulerDelayMs", 500)
    scheduler_delay_ratio: float = _set("schedulerDelayRatio", 0.5)
    result_serialization_ms: int = _set("resultSerializationMs", 200)
    executor_memory_cov: float = _set("executorMemoryCov", 0.5)
    executor_memory_min_count: int = _set("executorMemoryMinCount", 3)


@dataclass(frozen=True)
class SuggestionSettings(_Settings):
    broadcast_threshold_bytes: int = _set("suggestion.broadcastThresholdBytes", 100 * MIB)
    excessive_shuffle_count: int = _set("suggestion.excessiveShuffleCount", 4)
    partition_prune_scan_min_mb: int = _set("suggestion.partitionPruneScanMinMB", 1024)
    collect_large_data_min_mb: int = _set("suggestion.collectLargeDataMinMB", 100)


@dataclass(frozen=True)
class AutoFixSettings(_Settings):
    enabled: bool = _set("autofix.enabled", False)
    mode: str = _set("autofix.mode", "auto")
    store_path: str = _set("autofix.store.path", str(Path(tempfile.gettempdir()) / "keelson-autofix"))
    max_iterations: int = _set("autofix.maxIterations", 5)
    broadcast_max_bytes: int = _set("autofix.broadcastMaxBytes", 10 * MIB)
    target_partition_bytes: int = _set("autofix.targetPartitionBytes", 128 * MIB)
    skew_factor: float = _set("autofix.skew.factor", 10.0)
    skew_broadcast_max_bytes: int = _set("autofix.skew.broadcastMaxBytes", 100 * MIB)
    salt_factor: int = _set("autofix.skew.saltFactor", 16)
    targeted: bool = _set("autofix.skew.targeted", True)
    sample_fraction: float = _set("autofix.skew.sampleFraction", 0.01)
    threshold_multiplier: float = _set("autofix.skew.thresholdMultiplier", 10.0)
    max_keys: int = _set("autofix.skew.maxKeys", 100)

    @property
    def learns(self) -> bool:
        return self.enabled

    @property
    def applies(self) -> bool:
        return self.enabled and self.mode in ("auto", "fix")

    @property
    def shadows(self) -> bool:
        return self.enabled and self.mode == "shadow"


@dataclass(frozen=True)
class ResilientSettings(_Settings):
    enabled: bool = _set("resilientJoin.enabled", False)
    broadcast_threshold: int = _set("resilientJoin.broadcastThreshold", 100 * MIB)
    split_broadcast: bool = _set("resilientJoin.splitBroadcast.enabled", True)
    split_budget_bytes: int = _set("resilientJoin.splitBroadcast.budgetBytes", 100 * MIB)
    split_max_splits: int = _set("resilientJoin.splitBroadcast.maxSplits", 16)
    auto_salt: bool = _set("resilientJoin.autoSalt.enabled", True)
    salt_sample_fraction: float = _set("resilientJoin.autoSalt.sampleFraction", 0.01)
    salt_skew_multiplier: float = _set("resilientJoin.autoSalt.skewMultiplier", 10.0)
    salt_factor: int = _set("resilientJoin.autoSalt.saltFactor", 10)
    salt_min_hot_count: int = _set("resilientJoin.autoSalt.minHotKeyCount", 100)
