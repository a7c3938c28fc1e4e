"""Null-safe column helpers.

Missing values are NULL everywhere in this package (never NaN), so that a
comparison with a missing value is "not true" and aggregates skip it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """a / b, NULL when b is zero or either side is missing."""
    return F.try_divide(col(a), col(b))


def flag(cond: Column) -> Column:
    """0/1 flag; a missing comparison counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def sign(c) -> Column:
    """-1, 0 or 1 as int; a missing value counts as 0."""
    return F.coalesce(F.signum(col(c)), F.lit(0.0)).cast("int")


def nz(c, default) -> Column:
    """Replace an exact zero by ``default``; leave missing values missing."""
    return F.when(col(c) == 0, F.lit(default)).otherwise(col(c))


def finite(c) -> Column:
    """NaN and infinities become NULL."""
    x = col(c)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def full(n: int, c, window, value: Column) -> Column:
    """``value`` only where the n-row window holds n non-missing ``c``."""
    return F.when(F.count(col(c)).over(window) == n, value)


def total(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in skip]


def find_column(df: DataFrame, *keywords: str) -> str | None:
    """First column whose lower-cased name holds every keyword."""
    for name in df.columns:
        if all(k in name.lower() for k in keywords):
            return name
    return None


def elapsed_hours(later, earlier) -> Column:
    """Hours between two timestamps, fractional."""
    return (F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))) / F.lit(3.6e9)
