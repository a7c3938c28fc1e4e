"""Back-test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.axis import in_blocks
from ..operators import backtest as bt
from . import fixtures as fx
from .catalog import Shape, query
from .sqlkit import full, wins

C = F.col
LEVELS = fx.LEVELS_SQL


def _run_sql(source: str, key: str = "symbol", order: str = "ts", tag: str = "") -> str:
    """Positions, returns and equity from (key, order, close, w) where w is the signal weight."""
    w = f"(PARTITION BY {key} ORDER BY {order})"
    cum = f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
q1{tag} AS (SELECT *, coalesce(lag(w) OVER {w}, 0.0) AS position, coalesce(close / lag(close) OVER {w} - 1, 0) AS ret FROM {source}),
q2{tag} AS (SELECT *, position * ret - coalesce(abs(position - lag(position) OVER {w}), 0) * 0.0015 AS net_return FROM q1{tag}),
q3{tag} AS (SELECT *, product(1 + net_return) OVER {cum} * 10000 AS equity FROM q2{tag}),
q4{tag} AS (SELECT *, equity / max(equity) OVER {cum} - 1 AS drawdown FROM q3{tag})"""


def _metrics_sql(source: str, key: str = "symbol", order: str = "ts") -> str:
    return f"""
m1 AS (SELECT {key}, last(equity ORDER BY {order}) / first(equity ORDER BY {order}) - 1 AS cumulative_return, count(*) AS trading_days,
  stddev_samp(net_return) * sqrt(252) AS annualised_volatility, stddev_samp(least(net_return, 0)) * sqrt(252) AS down, min(drawdown) AS max_drawdown,
  avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, count(*) FILTER (WHERE net_return <> 0) AS trade_count FROM {source} GROUP BY ALL),
m2 AS (SELECT *, CASE WHEN trading_days > 1 THEN pow(1 + cumulative_return, 252.0 / trading_days) - 1 ELSE 0 END AS annualised_return FROM m1),
res AS (SELECT *, CASE WHEN annualised_volatility <> 0 THEN annualised_return / annualised_volatility ELSE 0 END AS sharpe_ratio,
  CASE WHEN down <> 0 THEN annualised_return / down ELSE 0 END AS sortino_ratio, CASE WHEN max_drawdown < 0 THEN -annualised_return / max_drawdown ELSE 0 END AS calmar_ratio FROM m2)"""


METRICS = ["cumulative_return", "annualised_return", "annualised_volatility", "max_drawdown", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "win_rate"]
_CROSS = f"""{LEVELS},
ma AS (SELECT *, CASE WHEN {full(5, "close", "avg(close) OVER w5")} <= {full(20, "close", "avg(close) OVER w20")} THEN 0.0 ELSE 1.0 END AS w FROM levels {wins(5, 20)}),
{_run_sql("ma")}"""
_mom = " + ".join(f"(lag(close, {k}) OVER w / lag(close, {k + 1}) OVER w - 1)" if k else "(close / lag(close, 1) OVER w - 1)" for k in range(5))
_MOM = lambda source: f"""
mm AS (SELECT *, CASE WHEN m > 0 THEN 1.0 WHEN m < 0 THEN -1.0 ELSE 0.0 END AS w FROM (SELECT *, {_mom} AS m FROM {source} {wins()})),
{_run_sql("mm")}"""


@query(
    "backtest_equity",
    Shape(["symbol"], ["ts"], [], ["position", "net_return"], ["drawdown"], [], ["equity"]),
    f"{_CROSS}, res AS (SELECT * FROM q4)",
)
def backtest_equity(spark, sf):
    return bt.backtest(fx.levels(spark, sf))


@query("backtest_metrics", Shape(["symbol"], [], ["trading_days", "trade_count"], METRICS), f"{_CROSS},{_metrics_sql('q4')}")
def backtest_metrics(spark, sf):
    return bt.metrics(bt.backtest(fx.levels(spark, sf)))


_TRADES = """
f AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY ts), 0) AS prev FROM q4),
g AS (SELECT *, sum(CASE WHEN position <> 0 AND prev = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS trade FROM f),
o AS (SELECT symbol, trade, ts AS entry_ts, close AS entry_price, position AS size FROM g WHERE position <> 0 AND prev = 0),
res AS (SELECT symbol, entry_ts, g.ts AS exit_ts, CASE WHEN size > 0 THEN 'long' ELSE 'short' END AS direction, entry_price, g.close AS exit_price,
  (g.close - entry_price) * size AS pnl FROM g JOIN o USING (symbol, trade) WHERE g.position = 0 AND g.prev <> 0)"""


@query(
    "backtest_trades",
    Shape(["symbol"], ["entry_ts", "exit_ts"], ["direction"], [], ["entry_price", "exit_price", "pnl"]),
    f"{LEVELS},{_MOM('levels').replace('CASE WHEN m > 0 THEN 1.0', 'CASE WHEN abs(m / 5) < 0.05 THEN 0.0 WHEN m > 0 THEN 1.0')},{_TRADES}",
)
def backtest_trades(spark, sf):
    """Trades with flips: flat inside a band, long above it, short below it."""
    banded = bt.Strategy(bt.MOMENTUM.features, lambda window=5: F.when(F.abs(f"_t_mom_{window}") < 0.05, "flat").when(C(f"_t_mom_{window}") > 0, "LONG").when(C(f"_t_mom_{window}") < 0, "Short").otherwise("flat"))
    return bt.trades(bt.backtest(fx.levels(spark, sf), banded))


@query(
    "momentum_validation",
    Shape(["symbol"], [], ["trading_days", "trade_count"], METRICS),
    f"""{LEVELS}, recent AS (SELECT * FROM levels WHERE ts >= (SELECT max(ts) FROM levels) - 400),
{_MOM("recent")},{_metrics_sql("q4")}""",
)
def momentum_validation(spark, sf):
    return bt.validate_recent(fx.levels(spark, sf), days_back=400)


@query(
    "param_sweep",
    Shape(["symbol"], [], ["short", "long", "trading_days", "trade_count"], METRICS),
    f"""{LEVELS},
grid AS (SELECT CAST(s AS INTEGER) AS short, CAST(l AS INTEGER) AS long FROM (VALUES (5), (10)) a(s), (VALUES (20), (50)) b(l)),
ms AS (SELECT *, {", ".join(full(n, "close", f"avg(close) OVER w{n}") + f" AS ma{n}" for n in (5, 10, 20, 50))} FROM levels {wins(5, 10, 20, 50)}),
sw AS (SELECT m.symbol, m.ts, m.close, g.short, g.long, CASE WHEN (CASE g.short WHEN 5 THEN ma5 ELSE ma10 END) <= (CASE g.long WHEN 20 THEN ma20 ELSE ma50 END) THEN 0.0 ELSE 1.0 END AS w
  FROM ms m CROSS JOIN grid g),
{_run_sql("sw", "symbol, short, long")},{_metrics_sql("q4", "symbol, short, long")}""",
)
def param_sweep(spark, sf):
    return bt.parameter_sweep(fx.levels(spark, sf), bt.MA_CROSS, {"short": [5, 10], "long": [20, 50]})


@query(
    "numeric_signals",
    Shape(["symbol"], ["ts"], [], ["position", "net_return"]),
    f"""{LEVELS}, nw AS (SELECT *, greatest(-1.0, least(1.0, ((close % 700) - 350) / 199.0)) AS w FROM levels),
{_run_sql("nw")}, res AS (SELECT * FROM q4)""",
)
def numeric_signals(spark, sf):
    b = fx.levels(spark, sf)
    signals = b.select("symbol", "ts", (((C("close") % 700) - 350) / 199.0).alias("signal"))
    return bt.run(bt.check_alignment(b, signals))


@query(
    "tick_backtest",
    Shape(["symbol"], [], ["event_id"], ["position", "net_return"], [], [], ["equity"]),
    f"""{fx.TICKS_SQL}, tw AS (SELECT symbol, ts, event_id, 10000 + close / 100 AS close, CASE WHEN event_id % 3 = 0 THEN 1.0 WHEN event_id % 3 = 1 THEN -1.0 ELSE 0.0 END AS w FROM ticks),
{_run_sql("tw", order="ts, event_id")}, res AS (SELECT * FROM q4)""",
)
def tick_backtest(spark, sf):
    """An equity curve per heavy key: running products and peaks carried across blocks."""
    word = F.when(C("event_id") % 3 == 0, "buy").when(C("event_id") % 3 == 1, "sell").otherwise("hold")
    t = fx.ticks(spark, sf).select("symbol", "ts", "event_id", (10000 + C("close") / 100).alias("close"), word.alias("signal"))
    return in_blocks(t, fx.TICKS, lambda d, a: bt.run(d, a), before=5)


@query(
    "performance_summary",
    Shape(["symbol"], [], [], ["volatility_30d", "return_30d", "max_drawdown", "sharpe_ratio"]),
    f"""{LEVELS},
r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, close / max(close) OVER cum - 1 AS dd, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM levels {wins()}),
res AS (SELECT symbol, stddev_samp(ret) FILTER (WHERE back <= 30) * sqrt(252) AS volatility_30d, max(close) FILTER (WHERE back = 1) / max(close) FILTER (WHERE back = 31) - 1 AS return_30d,
  min(dd) AS max_drawdown, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END AS sharpe_ratio FROM r GROUP BY 1)""",
)
def performance_summary(spark, sf):
    return bt.performance_summary(fx.levels(spark, sf))
