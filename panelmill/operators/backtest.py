"""Back-testing signals over price series.

Positions, costs, equity and trades are window and scan columns over the whole
panel: all symbols (and all parameter combinations of a sweep) run in one job.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import DAILY, Axis, Scan, Wave, apply_waves
from ..functions.exprs import div, full

C = F.col

# Default costs and capital.
COMMISSION, SLIPPAGE, CAPITAL = 0.001, 0.0005, 10_000.0
# Signal words and their weights; any other word is 0.
WORDS = {"buy": 1.0, "long": 1.0, "sell": -1.0, "short": -1.0, "hold": 0.0, "flat": 0.0}


def signal_weight(df: DataFrame, signal: str = "signal") -> Column:
    """Words to weights, numbers clipped to [-1, 1]."""
    if dict(df.dtypes)[signal] == "string":
        word = F.lower(C(signal))
        out = F.when(word.isin("buy", "long"), 1.0).when(word.isin("sell", "short"), -1.0)
        return out.otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), C(signal).cast("double")))


def run(
    df: DataFrame,
    axis: Axis = DAILY,
    price: str = "close",
    signal: str = "signal",
    commission: float = COMMISSION,
    slippage: float = SLIPPAGE,
    capital: float = CAPITAL,
) -> DataFrame:
    """Add position, gross_return, cost, net_return, equity and drawdown; a signal trades on the next row."""
    p = C(price)
    waves: list[Wave] = [
        {"_t_w": signal_weight(df, signal)},
        {"position": F.coalesce(axis.lag("_t_w"), F.lit(0.0)), "_t_ret": F.coalesce(axis.pct(p), F.lit(0.0))},
        {
            "gross_return": C("position") * C("_t_ret"),
            "cost": F.coalesce(F.abs(axis.diff("position")), F.lit(0.0)) * (commission + slippage),
        },
        {"net_return": C("gross_return") - C("cost")},
        {"_t_growth": Scan("product", 1 + C("net_return"))},
        {"equity": C("_t_growth") * capital},
        {"_t_peak": Scan("max", C("equity"))},
        {"drawdown": div(C("equity") - C("_t_peak"), "_t_peak")},
    ]
    return apply_waves(df, axis, waves)


def trades(result: DataFrame, axis: Axis = DAILY, price: str = "close") -> DataFrame:
    """Closed trades: opened from flat, closed on the return to flat.

    A flip from long to short keeps the first trade open; a trade still open
    at the end is left out.
    """
    before = F.coalesce(axis.lag("position"), F.lit(0.0))
    waves: list[Wave] = [
        {"_t_before": before},
        {
            "_t_entry": Scan(
                "last",
                F.when((C("position") != 0) & (C("_t_before") == 0), F.struct(C(axis.ts).alias("at"), C(price).alias("price"), C("position").alias("size"))),
            )
        },
    ]
    rows = apply_waves(result, axis, waves, keep_temp=True).filter((C("position") == 0) & (C("_t_before") != 0))
    entry = C("_t_entry")
    kept = [c for c in rows.columns if c.startswith("__") or c in axis.parts]
    return rows.select(
        *kept,
        entry["at"].alias("entry_ts"),
        C(axis.ts).alias("exit_ts"),
        F.when(entry["size"] > 0, "long").otherwise("short").alias("direction"),
        entry["price"].alias("entry_price"),
        C(price).alias("exit_price"),
        ((C(price) - entry["price"]) * entry["size"]).alias("pnl"),
    )


def metrics(result: DataFrame, axis: Axis = DAILY) -> DataFrame:
    """One row of performance figures per series, from mergeable aggregates."""
    order, r = F.struct(*axis.order), C("net_return")
    agg = result.groupBy(*axis.key).agg(
        F.min_by("equity", order).alias("_first"),
        F.max_by("equity", order).alias("_last"),
        F.count(F.lit(1)).alias("trading_days"),
        F.stddev_samp(r).alias("_sd"),
        F.stddev_samp(F.least(r, F.lit(0.0))).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.count_if(r != 0).alias("trade_count"),
    )
    total = C("_last") / C("_first") - 1
    year = math.sqrt(252)
    safe = lambda top, bottom: F.when(bottom != 0, top / bottom).otherwise(0.0)
    out = agg.withColumn("cumulative_return", total)
    out = out.withColumn("annualised_return", F.when(C("trading_days") > 1, F.pow(1 + C("cumulative_return"), F.lit(252.0) / C("trading_days")) - 1).otherwise(0.0))
    out = out.withColumn("annualised_volatility", C("_sd") * year)
    ann = C("annualised_return")
    return out.withColumns(
        {
            "sharpe_ratio": safe(ann, C("annualised_volatility")),
            "sortino_ratio": safe(ann, F.abs(C("_down") * year)),
            "calmar_ratio": F.when(C("max_drawdown") < 0, -ann / C("max_drawdown")).otherwise(0.0),
        }
    ).drop("_first", "_last", "_sd", "_down")


def check_alignment(prices: DataFrame, signals: DataFrame, axis: Axis = DAILY) -> DataFrame:
    """Join prices and signals; raise if their rows do not match one to one."""
    on = [*axis.key, axis.ts]
    both = prices.withColumn("_p", F.lit(1)).join(signals.withColumn("_s", F.lit(1)), on, "full")
    odd = both.filter(C("_p").isNull() | C("_s").isNull()).limit(1).count()
    if odd:
        raise ValueError("price and signal rows must match")
    return both.drop("_p", "_s")


# ------------------------------------------------------------ strategies


@dataclass(frozen=True)
class Strategy:
    """Named window features for a set of parameters, and the signal built from them.

    Features are named so that combinations of a sweep sharing a window length
    share one window expression.
    """

    features: Callable[..., dict[str, Column]]
    signal: Callable[..., Column]


def _cross_features(axis: Axis, price: str, short: int = 5, long: int = 20) -> dict[str, Column]:
    return {f"_t_ma_{n}": full(n, price, axis.last(n), F.avg(price).over(axis.last(n))) for n in (short, long)}


def _cross_signal(short: int = 5, long: int = 20) -> Column:
    # anything but "short at or below long" buys, which includes the rows before both means exist
    return F.when(C(f"_t_ma_{short}") <= C(f"_t_ma_{long}"), "hold").otherwise("buy")


MA_CROSS = Strategy(_cross_features, _cross_signal)


def _momentum_features(axis: Axis, price: str, window: int = 5) -> dict[str, Column]:
    p = C(price)
    # mean of the last n returns needs the returns first; n returns need n+1 prices
    rets = [F.try_divide(p if k == 0 else axis.lag(p, k), axis.lag(p, k + 1)) - 1 for k in range(window)]
    total = rets[0]
    for r in rets[1:]:
        total = total + r
    return {f"_t_mom_{window}": total / window}


def _momentum_signal(window: int = 5) -> Column:
    m = C(f"_t_mom_{window}")
    return F.when(m > 0, "buy").when(m < 0, "sell").otherwise("hold")


MOMENTUM = Strategy(_momentum_features, _momentum_signal)


def add_signal(df: DataFrame, strategy: Strategy, axis: Axis = DAILY, price: str = "close", out: str = "signal", **params) -> DataFrame:
    df = df.withColumns(strategy.features(axis, price, **params)).withColumn(out, strategy.signal(**params))
    return df.drop(*[c for c in df.columns if c.startswith("_t_")])


def parameter_sweep(
    df: DataFrame,
    strategy: Strategy,
    grid: dict[str, Sequence],
    axis: Axis = DAILY,
    price: str = "close",
    **costs,
) -> DataFrame:
    """Metrics for every parameter combination and series in one job.

    Signals of all combinations are columns of one pass over the bars; the
    combinations are then unfolded and become part of the series key.
    """
    names = list(grid)
    combos = [dict(zip(names, v)) for v in itertools.product(*grid.values())]
    feats: dict[str, Column] = {}
    for p in combos:
        feats.update(strategy.features(axis, price, **p))
    wide = df.select(*axis.parts, *axis.order, price).withColumns(feats)
    entries = F.array(*[F.struct(*[F.lit(p[k]).alias(k) for k in names], strategy.signal(**p).alias("signal")) for p in combos])
    long = wide.select(*axis.parts, *axis.order, price, F.inline(entries))
    each = replace(axis, key=(*axis.key, *names))
    return metrics(run(long, each, price, **costs), each)


def backtest(df: DataFrame, strategy: Strategy = MA_CROSS, axis: Axis = DAILY, price: str = "close", **params) -> DataFrame:
    return run(add_signal(df, strategy, axis, price, **params), axis, price)


def validate_recent(df: DataFrame, days_back: int = 90, until=None, axis: Axis = DAILY, price: str = "close") -> DataFrame:
    """Momentum back-test metrics of every symbol over the last ``days_back`` days."""
    last = F.lit(until).cast("date") if until is not None else F.lit(df.agg(F.max(axis.ts)).first()[0]).cast("date")
    recent = df.filter(C(axis.ts).cast("date") >= F.date_sub(last, days_back))
    return metrics(backtest(recent, MOMENTUM, axis, price), axis)


def performance_summary(df: DataFrame, axis: Axis = DAILY, price: str = "close", window: int = 30) -> DataFrame:
    """Recent volatility and return, deepest drawdown and Sharpe ratio per series."""
    p, year = C(price), math.sqrt(252)
    waves: list[Wave] = [
        {"_t_ret": axis.pct(p), "_t_peak": Scan("max", p), "_t_then": axis.lag(p, window)},
        {"_t_vol": F.stddev_samp("_t_ret").over(axis.last(window)), "_t_dd": p / C("_t_peak") - 1},
    ]
    rows = apply_waves(df, axis, waves, keep_temp=True)
    order = F.struct(*axis.order)
    out = rows.groupBy(*axis.key).agg(
        (F.max_by("_t_vol", order) * year).alias("volatility_30d"),
        (F.max_by(p / C("_t_then") - 1, order)).alias("return_30d"),
        F.min("_t_dd").alias("max_drawdown"),
        F.avg("_t_ret").alias("_m"),
        F.stddev_samp("_t_ret").alias("_s"),
    )
    return out.withColumn("sharpe_ratio", F.when(C("_s") > 0, C("_m") / C("_s") * year).otherwise(0.0)).drop("_m", "_s")
