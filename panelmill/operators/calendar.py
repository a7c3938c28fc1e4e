"""Regular time grids and resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import DAILY, Axis, Scan, running
from .joins import asof_join

C = F.col
STEP = {"day": "interval 1 day", "business": "interval 1 day", "hour": "interval 1 hour", "4 hours": "interval 4 hours"}


def grid(df: DataFrame, unit: str = "day", axis: Axis = DAILY, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """One row per (key, step) between each key's first and last time; 'business' keeps Monday to Friday."""
    t = C(axis.ts)
    if unit == "hour":
        t = F.date_trunc("hour", t)
    elif unit == "4 hours":
        t = F.date_trunc("day", t) + F.expr("interval 4 hours") * F.floor(F.hour(t) / 4)
    else:
        t = t.cast("date")
    t = t.cast("date") if unit in ("day", "business") else t.cast("timestamp_ntz")
    spans = df.groupBy(*axis.key).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    steps = F.sequence(lo if lo is not None else C("_lo"), hi if hi is not None else C("_hi"), F.expr(STEP[unit]))
    out = spans.select(*axis.key, F.explode(steps).alias(axis.ts))
    return out.filter(F.weekday(axis.ts) < 5) if unit == "business" else out


def to_business_days(df: DataFrame, values: Sequence[str], axis: Axis = DAILY) -> DataFrame:
    """Monday-to-Friday grid, each day holding the latest row on or before it."""
    return asof_join(grid(df, "business", axis), df, values, axis)


def densify(df: DataFrame, values: Sequence[str], unit: str = "day", axis: Axis = DAILY) -> DataFrame:
    """Every step of the calendar, gaps carried forward."""
    full = grid(df, unit, axis).join(df.select(*axis.key, axis.ts, *values), [*axis.key, axis.ts], "left")
    return running(full, axis, {v: Scan("last", C(v)) for v in values})


def as_frequency(df: DataFrame, values: Sequence[str], axis: Axis = DAILY, business: bool | None = None) -> DataFrame:
    """Regularise a daily series; without ``business`` the frequency is inferred from weekend rows."""
    if business is None:
        business = df.filter(F.weekday(axis.ts) >= 5).limit(1).count() == 0
    return to_business_days(df, values, axis) if business else densify(df, values, "day", axis)


def resample(df: DataFrame, aggs: Sequence[Column], unit: str = "day", axis: Axis = DAILY) -> DataFrame:
    """Tumbling buckets per key, empty buckets included as missing."""
    t = {"day": C(axis.ts).cast("date"), "hour": F.date_trunc("hour", C(axis.ts)).cast("timestamp_ntz")}.get(unit)
    if t is None:
        t = (F.date_trunc("day", C(axis.ts)) + F.expr("interval 4 hours") * F.floor(F.hour(axis.ts) / 4)).cast("timestamp_ntz")
    buckets = df.withColumn("_bucket", t).groupBy(*axis.key, "_bucket").agg(*aggs).withColumnRenamed("_bucket", axis.ts)
    return grid(df, unit, axis).join(buckets, [*axis.key, axis.ts], "left")


def next_weekdays(last: Column, n: int) -> Column:
    """The ``n`` weekdays after a date, as an array."""
    day, reach = last.cast("date"), n * 7 // 5 + 3
    return F.slice(F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, reach)), lambda d: F.weekday(d) < 5), 1, n)


def future_business_days(df: DataFrame, horizon: int, axis: Axis = DAILY) -> DataFrame:
    """The next ``horizon`` weekdays after each key's last row, numbered by ``step``."""
    last = df.groupBy(*axis.key).agg(F.max(C(axis.ts).cast("date")).alias("_last"))
    return last.select(*axis.key, F.posexplode(next_weekdays(C("_last"), horizon)).alias("_i", axis.ts)).withColumn("step", C("_i") + 1).drop("_i")
