"""Column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

#: Timestamps down to the microsecond: by default `to_json` prints milliseconds and would hide smaller changes.
MICROSECONDS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def name(column: str) -> str:
    """A column name as an identifier, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def flat(kind: DataType) -> bool:
    """Whether `row_hash` differs exactly where values do; inside arrays and structs it tells 0.0 from -0.0."""
    return not isinstance(kind, (ArrayType, MapType, StructType))


def row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """A 64-bit hash of the row as JSON, null fields kept; 0.0 and -0.0 are one value."""
    plus = lambda c: F.col(name(c)) + F.lit(0.0).cast(df.schema[c].dataType) if isinstance(df.schema[c].dataType, (DoubleType, FloatType)) else F.col(name(c))
    return F.xxhash64(F.to_json(F.struct(*[plus(c).alias(c) for c in columns]), {**MICROSECONDS, "ignoreNullFields": "false"}))


def bucket_of(keys: Sequence[str], n: int) -> Column:
    """Which of n disjoint parts a row belongs to; rows with null keys belong to one, too."""
    return F.pmod(F.hash(*[F.col(name(k)) for k in keys]), F.lit(n))


def equi_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return all_of(left[k].eqNullSafe(right[k]) for k in keys)
