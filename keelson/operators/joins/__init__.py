"""Joins that recover from failures and spread skewed keys."""

from .resilient import JoinConfig, ResilientJoinExhausted, resilient_join
from .salted import AutoSaltConfig, auto_salt_join, salted_join
from .skew import hot_keys
from .split_broadcast import SplitBroadcastConfig, SplitBroadcastExhausted, split_broadcast_join, split_join
from .strategies import BroadcastStrategy, FailureContext, JoinStrategy, RepartitionStrategy, ShuffledHashStrategy, SortMergeStrategy

__all__ = [
    "AutoSaltConfig", "BroadcastStrategy", "FailureContext", "JoinConfig", "JoinStrategy", "RepartitionStrategy", "ResilientJoinExhausted", "ShuffledHashStrategy",
    "SortMergeStrategy", "SplitBroadcastConfig", "SplitBroadcastExhausted", "auto_salt_join", "hot_keys", "resilient_join", "salted_join", "split_broadcast_join", "split_join",
]
