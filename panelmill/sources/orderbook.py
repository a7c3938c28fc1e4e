"""Level-2 order-book snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


def load_orderbook_csv(spark: SparkSession, path: str, depth: int = 5, tz: str | None = None) -> DataFrame:
    """Read snapshots: UTC times (moved to ``tz``), the top ``depth`` levels, level 1 named without its number.

    Column names are matched in any case; a missing level raises ``ValueError``.
    """
    raw = spark.read.option("header", True).csv(path)
    return select_levels(raw, depth, tz)


def select_levels(raw: DataFrame, depth: int = 5, tz: str | None = None) -> DataFrame:
    have = {c.lower(): c for c in raw.columns}
    wanted = [f"{side}_{what}_{k}" for k in range(1, depth + 1) for side in ("bid", "ask") for what in ("price", "size")]
    gone = [c for c in ["timestamp", *wanted] if c not in have]
    if gone:
        raise ValueError(f"missing order book columns: {gone}")
    ts = F.try_to_timestamp(C(have["timestamp"]))
    if tz:
        ts = F.from_utc_timestamp(ts, tz)
    others = [C(have[c]) for c in ("symbol",) if c in have]
    levels = [C(have[c]).cast("double").alias(c[:-2] if c.endswith("_1") else c) for c in wanted]
    return raw.select(*others, ts.alias("ts"), *levels)
