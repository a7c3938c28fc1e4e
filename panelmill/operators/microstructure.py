"""Quote features and order-book level aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axis import DAILY, Axis
from ..functions.exprs import div, find_column, nz, total


def microstructure(df: DataFrame, axis: Axis = DAILY) -> DataFrame:
    """Mid price, relative spread, log-mid return and quote imbalance.

    Works with whatever bid/ask columns exist; a feature whose inputs are
    absent is left out.  The lag makes this the one quote feature that needs
    the series order.
    """
    bid, ask = find_column(df, "bid", "price"), find_column(df, "ask", "price")
    bid_size, ask_size = find_column(df, "bid", "size"), find_column(df, "ask", "size")
    if bid and ask:
        df = df.withColumn("micro_mid_price", (F.col(bid) + F.col(ask)) / 2)
        log_mid = F.when(F.col("micro_mid_price") > 0, F.ln("micro_mid_price"))
        df = df.withColumns(
            {
                "micro_spread_pct": div(F.col(ask) - F.col(bid), "micro_mid_price"),
                "micro_mid_return": log_mid - axis.lag(log_mid),
            }
        )
    if bid_size and ask_size:
        b, a = F.col(bid_size), F.col(ask_size)
        df = df.withColumn("micro_quote_imbalance", (b - a) / (b + a + 1e-8))
    return df


def aggregate_levels(df: DataFrame, depth: int = 5) -> DataFrame:
    """Size-weighted bid/ask over up to ``depth`` levels: mid, relative spread, total size."""
    have = set(df.columns)
    sides = {}
    for side in ("bid", "ask"):
        levels = [k for k in range(1, depth + 1) if {f"{side}_price_{k}", f"{side}_size_{k}"} <= have]
        if not levels:
            return df
        size = total([F.col(f"{side}_size_{k}") for k in levels])
        value = total([F.col(f"{side}_price_{k}") * F.col(f"{side}_size_{k}") for k in levels])
        sides[side] = (value / (size + 1e-8), size)
    (bid, bid_size), (ask, ask_size) = sides["bid"], sides["ask"]
    mid = (bid + ask) / 2
    return df.withColumns(
        {"ob_mid_price_wap": mid, "ob_spread_wap": div(ask - bid, nz(mid, None)), "ob_total_volume": bid_size + ask_size}
    )
