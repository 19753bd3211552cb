"""A Spark-native toolkit: dataset diff, resilient and skew-aware joins, plan hints, a closed-loop tuner and diagnostics."""
