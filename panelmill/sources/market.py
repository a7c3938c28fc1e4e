"""Price bars and quotes: reading, normalising, latest snapshots, symbol checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.axis import DAILY, Axis
from ..functions.exprs import div
from ..operators.clean import back_fill, forward_fill
from .sinks import MONTH

C = F.col

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)
FINAL_COLUMNS = ("open", "high", "low", "close", "volume")


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower case, blanks to underscores."""
    return df.select(*[C(f"`{c}`").alias(c.strip().replace(" ", "_").lower()) for c in df.columns])


def in_range(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Inclusive date range; pushed into the scan when ``df`` is a file source."""
    if start is not None:
        df = df.filter(C(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end is not None:
        df = df.filter(C(ts) <= F.lit(end).cast(df.schema[ts].dataType))
    return df


def read_bars(
    spark: SparkSession,
    paths: str | Sequence[str],
    symbols: Sequence[str] | None = None,
    start=None,
    end=None,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Bars of many symbols in one scan, filtered by symbol and date at the source."""
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        reader = reader.schema(schema or BAR_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load([paths] if isinstance(paths, str) else list(paths))
    if fmt in ("parquet", "orc"):
        df = normalise_names(df)
    if symbols is not None:
        df = df.filter(C("symbol").isin(*symbols))
    return in_range(df, start, end)


def stack_bars(frames: Sequence[DataFrame], axis: Axis = DAILY, fill: bool = True) -> DataFrame:
    """Union of symbol tables with a fixed column list (absent columns are 0.0), gaps filled per symbol."""
    shaped = []
    for f in frames:
        f = normalise_names(f)
        shaped.append(f.select(*axis.key, axis.ts, *[C(c).cast("double").alias(c) if c in f.columns else F.lit(0.0).alias(c) for c in FINAL_COLUMNS]))
    out = reduce(DataFrame.unionByName, shaped)
    return back_fill(forward_fill(out, FINAL_COLUMNS, axis), FINAL_COLUMNS, axis) if fill else out


def latest_quotes(df: DataFrame, axis: Axis = DAILY, price: str = "close") -> DataFrame:
    """Latest row per symbol with the change against the row before it.

    The two newest prices of a symbol are kept as a bounded aggregate, so a
    symbol's history is never sorted or gathered.
    """
    order = F.struct(*axis.order)
    last = df.groupBy(*axis.key).agg(F.max(order).alias("_o"), F.max_by(F.struct(*df.columns), order).alias("_r"))
    rest = [c for c in df.columns if c not in axis.key]
    prev = (
        df.join(last.select(*axis.key, "_o"), list(axis.key))
        .filter(order < C("_o"))
        .groupBy(*axis.key)
        .agg(F.max_by(price, order).alias("previous_close"))
    )
    out = last.select(*axis.key, *[C("_r")[c].alias(c) for c in rest]).join(prev, list(axis.key), "left")
    change = C(price) - C("previous_close")
    return out.withColumns({"change": change, "change_pct": div(change, "previous_close") * 100})


INFO_TEXT = ("name", "sector", "industry")
INFO_ZERO = ("market_cap", "dividend_yield", "avg_volume")
INFO_OPTIONAL = ("pe_ratio", "beta", "high_52_week", "low_52_week")


def stock_info(df: DataFrame) -> DataFrame:
    """Twelve descriptive fields per symbol: texts default to 'N/A', sizes to 0, ratios stay missing."""
    have = set(df.columns)
    known = lambda c, kind: C(c).cast(kind) if c in have else F.lit(None).cast(kind)
    return df.select(
        "symbol",
        *[F.coalesce(known(c, "string"), F.lit("N/A")).alias(c) for c in INFO_TEXT],
        *[F.coalesce(known(c, "double"), F.lit(0.0)).alias(c) for c in INFO_ZERO],
        *[known(c, "double").alias(c) for c in INFO_OPTIONAL],
        F.coalesce(F.substring(known("description", "string"), 1, 500), F.lit("N/A")).alias("description"),
    )


def check_symbols(requested: DataFrame, known: DataFrame, key: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) parts of the requested symbols."""
    return requested.join(known, key, "left_semi"), requested.join(known, key, "left_anti")


def read_bar_table(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Bars of a table that ``sinks.write_bar_table`` wrote: only the months of the range are listed for the scan, and of their
    files only row groups that can hold the symbols are read."""
    df = spark.read.parquet(path)
    month = lambda day: F.date_format(F.lit(day).cast("date"), "yyyyMM").cast("int")
    if start is not None:
        df = df.filter(C(MONTH) >= month(start))
    if end is not None:
        df = df.filter(C(MONTH) <= month(end))
    if symbols is not None:
        df = df.filter(C("symbol").isin(*symbols))
    return in_range(df, start, end, ts).drop(MONTH)
