"""Writers for results, metrics and the quality history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "month"  # partition column of a bar table, yyyymm


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_bar_table(bars: DataFrame, path: str, files_per_month: int = 4, ts: str = "ts", symbol: str = "symbol") -> None:
    """Write bars partitioned by month; months that are there already are replaced, all others stay as they are.

    A month is dealt to ``files_per_month`` files by symbol, and a file is sorted by (symbol, ts): a read by symbol skips the row
    groups of others by their ranges.
    """
    laid = bars.withColumn(MONTH, F.date_format(F.col(ts), "yyyyMM").cast("int"))
    laid = laid.withColumn("_file", F.pmod(F.xxhash64(symbol), F.lit(files_per_month)))
    # as many tasks as Spark sees fit; a (month, file) is in one of them
    laid = laid.repartition(MONTH, "_file").sortWithinPartitions(MONTH, "_file", symbol, ts).drop("_file")
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def append_history(run: DataFrame, path: str) -> None:
    """Add one run to an append-only history."""
    run.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)
