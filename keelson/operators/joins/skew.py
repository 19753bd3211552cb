"""Hot keys: those with many times the usual number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.columns import all_of, name


def hot_keys(df: DataFrame, keys: Sequence[str], sample_fraction: float = 0.01, multiplier: float = 10.0, min_count: int = 100, max_keys: int = 1000, seed: int = 42) -> DataFrame:
    """The keys and `freq` (in the sample), most frequent first: those with at least `multiplier` times the median
    frequency, and `min_count` rows scaled to the sample. At most `max_keys` rows; null keys are never hot.

    A fraction of 1 reads every row and takes the exact median; otherwise the median is approximate.
    """
    rows = df if sample_fraction >= 1.0 else df.sample(False, sample_fraction, seed)
    columns = [F.col(name(k)) for k in keys]
    counts = rows.where(all_of(c.isNotNull() for c in columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("freq"))
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY freq)") if sample_fraction >= 1.0 else F.percentile_approx("freq", 0.5, 1000)
    floor = float(max(int(min_count * min(sample_fraction, 1.0)), 1))
    limit = counts.agg(F.greatest(median.cast("double") * float(multiplier), F.lit(floor)).alias("limit")).first()["limit"]
    if limit is None:
        return counts.limit(0)
    return counts.where(F.col("freq") >= limit).orderBy(F.desc("freq"), *columns).limit(max_keys)
