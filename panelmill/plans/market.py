"""Indicator queries over price bars, ticks and the order book."""

from __future__ import annotations

from ..functions.axis import in_blocks
from ..operators import indicators as ind
from ..operators import microstructure as micro
from . import fixtures as fx
from .catalog import Shape, query
from .sqlkit import d, ema_chain, fl, full, rsi, sg, wins

SMA = (5, 10, 20, 50, 100, 200)
BARS = fx.BARS_SQL


# ------------------------------------------------------------ moving averages
_sma_sql = f"""{BARS},
m AS (SELECT *, {", ".join(f"avg(close) OVER w{n} AS SMA_{n}" for n in SMA)} FROM bars {wins(*SMA)}),
res AS (SELECT *, {", ".join(f"{d('close', f'SMA_{n}')} AS SMA_{n}_ratio, {d(f'close - SMA_{n}', f'SMA_{n}')} * 100 AS SMA_{n}_distance" for n in SMA)},
  {fl("SMA_20 > SMA_50")} AS MA_golden_cross, {fl("SMA_20 < SMA_50")} AS MA_death_cross FROM m)"""


@query(
    "sma_features",
    Shape(
        ["symbol"], ["ts"], ["MA_golden_cross", "MA_death_cross"],
        [f"SMA_{n}_{k}" for n in SMA for k in ("ratio", "distance")], [f"SMA_{n}" for n in SMA],
    ),
    _sma_sql,
)
def sma_features(spark, sf):
    return ind.add_moving_averages(fx.bars(spark, sf), ema=(), wma=())


def _wma(n: int) -> str:
    lags = " + ".join(f"{n - k} * " + ("close" if k == 0 else f"lag(close, {k}) OVER w") for k in range(n))
    return f"({lags}) / {n * (n + 1) / 2}"


@query(
    "wma",
    Shape(["symbol"], ["ts"], [], ["WMA_10_ratio", "WMA_20_ratio"], ["WMA_10", "WMA_20"]),
    f"""{BARS},
m AS (SELECT *, {_wma(10)} AS WMA_10, {_wma(20)} AS WMA_20 FROM bars {wins()}),
res AS (SELECT *, {d("close", "WMA_10")} AS WMA_10_ratio, {d("close", "WMA_20")} AS WMA_20_ratio FROM m)""",
)
def wma(spark, sf):
    return ind.add_moving_averages(fx.bars(spark, sf), sma=(), ema=(), wma=(10, 20))


_macd_cols = ["MACD_bullish_crossover", "MACD_bearish_crossover", "MACD_zero_cross_up", "MACD_zero_cross_down"]
_ema_sql = f"""{BARS},{ema_chain("bars", {"EMA_12": ("close", 12), "EMA_26": ("close", 26), "EMA_50": ("close", 50)}, "e")},
l AS (SELECT *, EMA_12 - EMA_26 AS MACD FROM e),{ema_chain("l", {"MACD_signal": ("MACD", 9)}, "s")},
h AS (SELECT *, MACD - MACD_signal AS MACD_histogram FROM s),
res AS (SELECT *, {", ".join(f"{d('close', f'EMA_{n}')} AS EMA_{n}_ratio, {d(f'close - EMA_{n}', f'EMA_{n}')} * 100 AS EMA_{n}_distance" for n in (12, 26, 50))},
  {fl("EMA_12 > EMA_26")} AS EMA_bull_signal, {fl("EMA_12 < EMA_26")} AS EMA_bear_signal,
  {fl("MACD > MACD_signal AND lag(MACD) OVER w <= lag(MACD_signal) OVER w")} AS MACD_bullish_crossover,
  {fl("MACD < MACD_signal AND lag(MACD) OVER w >= lag(MACD_signal) OVER w")} AS MACD_bearish_crossover,
  {fl("MACD > 0 AND lag(MACD) OVER w <= 0")} AS MACD_zero_cross_up,
  {fl("MACD < 0 AND lag(MACD) OVER w >= 0")} AS MACD_zero_cross_down,
  MACD - lag(MACD) OVER w AS MACD_momentum, MACD_histogram - lag(MACD_histogram) OVER w AS MACD_histogram_momentum,
  {d("MACD", "close")} * 100 AS MACD_normalized FROM h {wins()})"""


@query(
    "ema_macd",
    Shape(
        ["symbol"], ["ts"], ["EMA_bull_signal", "EMA_bear_signal", *_macd_cols],
        [f"EMA_{n}_{k}" for n in (12, 26, 50) for k in ("ratio", "distance")] + ["MACD_normalized"],
        ["EMA_12", "EMA_26", "EMA_50", "MACD", "MACD_signal", "MACD_histogram", "MACD_momentum", "MACD_histogram_momentum"],
    ),
    _ema_sql,
)
def ema_macd(spark, sf):
    b = fx.bars(spark, sf)
    return ind.apply_waves(b, ind.DAILY, ind.moving_averages(sma=(), wma=()), ind.macd())


# ------------------------------------------------------------ oscillators
_moves = "CASE WHEN x > 0 THEN x ELSE 0 END AS gain, CASE WHEN x < 0 THEN -x ELSE 0 END AS loss"
_steps = f"g AS (SELECT *, {_moves} FROM (SELECT *, close - lag(close) OVER w AS x FROM bars {wins()}))"
_rsi_derived = ", ".join(
    f"{fl(f'RSI_{n} > 70')} AS RSI_{n}_overbought, {fl(f'RSI_{n} < 30')} AS RSI_{n}_oversold, (RSI_{n} - 50) / 50 AS RSI_{n}_normalized, "
    f"RSI_{n} - lag(RSI_{n}) OVER w AS RSI_{n}_momentum, {sg(f'(RSI_{n} - lag(RSI_{n}) OVER w)')} AS RSI_{n}_trend"
    for n in (14, 21, 30)
)


@query(
    "rsi",
    Shape(
        ["symbol"], ["ts"],
        [f"RSI_{n}_{k}" for n in (14, 21, 30) for k in ("overbought", "oversold", "trend")] + ["RSI_bullish_divergence", "RSI_bearish_divergence"],
        [f"RSI_{n}{k}" for n in (14, 21, 30) for k in ("", "_normalized", "_momentum")],
    ),
    f"""{BARS}, {_steps},
r AS (SELECT *, {", ".join(f"{rsi(n)} AS RSI_{n}" for n in (14, 21, 30))} FROM g {wins(14, 21, 30)}),
res AS (SELECT *, {_rsi_derived},
  coalesce(close < lag(close, 5) OVER w AND RSI_14 > lag(RSI_14, 5) OVER w, false) AS RSI_bullish_divergence,
  coalesce(close > lag(close, 5) OVER w AND RSI_14 < lag(RSI_14, 5) OVER w, false) AS RSI_bearish_divergence FROM r {wins()})""",
)
def rsi_query(spark, sf):
    return ind.add_rsi(fx.bars(spark, sf))


_bb = "BB_lower_20", "BB_upper_20", "BB_width_normalized_20"


@query(
    "bollinger",
    Shape(
        ["symbol"], ["ts"], ["BB_upper_touch_20", "BB_lower_touch_20", "BB_squeeze_20"],
        ["BB_width_normalized_20", "BB_position_20", "BB_percent_b_20", "BB_upper_distance_20", "BB_lower_distance_20"],
        ["BB_middle_20", "BB_upper_20", "BB_lower_20", "BB_width_20", "BB_upper_20_1_0", "BB_lower_20_2_5"],
    ),
    f"""{BARS},
b0 AS (SELECT *, avg(close) OVER w20 AS BB_middle_20, stddev_samp(close) OVER w20 AS sd FROM bars {wins(20)}),
b1 AS (SELECT *, BB_middle_20 + 2 * sd AS BB_upper_20, BB_middle_20 - 2 * sd AS BB_lower_20, BB_middle_20 + sd AS "BB_upper_20_1_0",
  BB_middle_20 - 2.5 * sd AS "BB_lower_20_2_5" FROM b0),
b2 AS (SELECT *, BB_upper_20 - BB_lower_20 AS BB_width_20, {d("BB_upper_20 - BB_lower_20", "BB_middle_20")} AS BB_width_normalized_20 FROM b1),
res AS (SELECT *, {d("close - BB_lower_20", "BB_width_20")} AS BB_position_20, {d("close - BB_lower_20", "BB_width_20")} AS BB_percent_b_20,
  (BB_upper_20 - close) / close * 100 AS BB_upper_distance_20, (close - BB_lower_20) / close * 100 AS BB_lower_distance_20,
  {fl("close >= BB_upper_20")} AS BB_upper_touch_20, {fl("close <= BB_lower_20")} AS BB_lower_touch_20,
  {fl("BB_width_normalized_20 < " + full(50, "BB_width_normalized_20", "quantile_cont(BB_width_normalized_20, 0.2) OVER w50"))} AS BB_squeeze_20
  FROM b2 {wins(50)})""",
)
def bollinger(spark, sf):
    return ind.add_bollinger(fx.bars(spark, sf))


@query(
    "stoch_willr_cci",
    Shape(
        ["symbol"], ["ts"],
        ["Stoch_overbought", "Stoch_oversold", "Williams_R_overbought", "Williams_R_oversold", "CCI_overbought", "CCI_oversold"],
        ["Stoch_K", "Stoch_D", "Williams_R", "CCI"],
    ),
    f"""{BARS},
s0 AS (SELECT *, max(high) OVER w14 AS hh, min(low) OVER w14 AS ll, (high + low + close) / 3 AS tp FROM bars {wins(14)}),
s1 AS (SELECT *, {d("close - ll", "hh - ll")} * 100 AS Stoch_K, {d("hh - close", "hh - ll")} * -100 AS Williams_R,
  avg(tp) OVER w20 AS tpm, list(tp) OVER w20 AS tpl FROM s0 {wins(20)}),
s2 AS (SELECT *, list_avg(list_transform(tpl, lambda x: abs(x - tpm))) AS mad FROM s1),
s3 AS (SELECT *, {d("tp - tpm", "0.015 * mad")} AS CCI FROM s2),
res AS (SELECT *, avg(Stoch_K) OVER w3 AS Stoch_D, {fl("Stoch_K > 80")} AS Stoch_overbought, {fl("Stoch_K < 20")} AS Stoch_oversold,
  {fl("Williams_R > -20")} AS Williams_R_overbought, {fl("Williams_R < -80")} AS Williams_R_oversold,
  {fl("CCI > 100")} AS CCI_overbought, {fl("CCI < -100")} AS CCI_oversold FROM s3 {wins(3)})""",
)
def stoch_willr_cci(spark, sf):
    return ind.apply_waves(fx.bars(spark, sf), ind.DAILY, ind.stochastic(), ind.williams_r(), ind.cci())


# ------------------------------------------------------------ volume and momentum
def _pvt_signal_sql(source: str, out: str) -> str:
    # adjusted weights: numerator and denominator recursions, started at the first known PVT
    q = 1 - 2 / 10
    return f"""
{out}_in AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn_ FROM {source}),
{out}_rec AS (
  SELECT symbol, rn_, coalesce(PVT, 0.0)::DOUBLE AS num, CASE WHEN PVT IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS den FROM {out}_in WHERE rn_ = 1
  UNION ALL
  SELECT b.symbol, b.rn_, coalesce(b.PVT, 0.0) + {q!r} * p.num, CASE WHEN b.PVT IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE + {q!r} * p.den
  FROM {out}_rec p JOIN {out}_in b ON b.symbol = p.symbol AND b.rn_ = p.rn_ + 1),
{out} AS (SELECT i.*, r.num / NULLIF(r.den, 0) AS PVT_signal FROM {out}_in i JOIN {out}_rec r ON r.symbol = i.symbol AND r.rn_ = i.rn_)"""


@query(
    "volume_indicators",
    Shape(
        ["symbol"], ["ts"], ["OBV_trend", "Volume_spike", "Volume_dry_up"],
        ["Volume_ratio_10", "Volume_ratio_20", "Volume_ratio_50", "VWAP_distance", "Volume_oscillator", "Volume_momentum", "Volume_acceleration"],
        ["Volume_SMA_10", "Volume_SMA_20", "Volume_SMA_50", "OBV", "VWAP", "PVT", "PVT_signal", "AD_line"],
    ),
    f"""{BARS},
v0 AS (SELECT *, avg(volume) OVER w10 AS Volume_SMA_10, avg(volume) OVER w20 AS Volume_SMA_20, avg(volume) OVER w50 AS Volume_SMA_50,
  volume * {sg("(close - lag(close) OVER w)")} AS obv1, volume * (close / lag(close) OVER w - 1) AS pvt1,
  volume / lag(volume) OVER w - 1 AS Volume_momentum, (high + low + close) / 3 AS tp,
  coalesce({d("(close - low) - (high - close)", "high - low")}, 0) * volume AS ad1 FROM bars {wins(10, 20, 50)}),
v1 AS (SELECT *, sum(obv1) OVER cum AS OBV, sum(pvt1) OVER cum AS PVT, sum((high + low + close) * volume) OVER cum / NULLIF(3 * sum(volume) OVER cum, 0) AS VWAP,
  sum(ad1) OVER cum AS AD_line FROM v0 {wins()}),
{_pvt_signal_sql("v1", "v2")},
res AS (SELECT *, {d("volume", "Volume_SMA_10")} AS Volume_ratio_10, {d("volume", "Volume_SMA_20")} AS Volume_ratio_20,
  {d("volume", "Volume_SMA_50")} AS Volume_ratio_50, CASE WHEN lag(OBV, 9) OVER w IS NOT NULL THEN {sg("(OBV - lag(OBV, 9) OVER w)")} END AS OBV_trend,
  (close - VWAP) / VWAP * 100 AS VWAP_distance, {d("Volume_SMA_10 - Volume_SMA_20", "Volume_SMA_20")} * 100 AS Volume_oscillator,
  {fl("volume > Volume_SMA_20 * 2")} AS Volume_spike, {fl("volume < Volume_SMA_20 * 0.5")} AS Volume_dry_up,
  Volume_momentum - lag(Volume_momentum) OVER w AS Volume_acceleration FROM v2 {wins()})""",
)
def volume_indicators(spark, sf):
    return ind.add_volume_indicators(fx.bars(spark, sf))


def _momentum_sql(source: str) -> str:
    roc = ", ".join(f"{d(f'close - lag(close, {n}) OVER w', f'lag(close, {n}) OVER w')} * 100 AS ROC_{n}" for n in (1, 5, 10, 20))
    mom = ", ".join(
        f"close - lag(close, {n}) OVER w AS Momentum_{n}, (close - lag(close, {n}) OVER w) / close * 100 AS Momentum_{n}_normalized" for n in (5, 10, 20)
    )
    return f"""
p0 AS (SELECT *, close / lag(close) OVER w - 1 AS ret, {roc}, {mom},
  close - 2 * lag(close) OVER w + lag(close, 2) OVER w AS Price_acceleration,
  {full(20, "close", "max(close) OVER w20")} AS Recent_high_20, {full(20, "close", "min(close) OVER w20")} AS Recent_low_20,
  {d("close - lag(close, 10) OVER w", full(10, "close", "stddev_samp(close) OVER w10"))} AS Trend_strength_10,
  {fl("close > lag(close) OVER w * 1.02")} AS Gap_up, {fl("close < lag(close) OVER w * 0.98")} AS Gap_down,
  {fl("close > lag(close) OVER w AND lag(close) OVER w > lag(close, 2) OVER w")} AS Higher_high,
  {fl("close < lag(close) OVER w AND lag(close) OVER w < lag(close, 2) OVER w")} AS Lower_low,
  greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM {source} {wins(10, 20)}),
p1 AS (SELECT *, ret - lag(ret) OVER w AS Returns_acceleration, (Recent_high_20 - close) / close * 100 AS Distance_from_high,
  (close - Recent_low_20) / close * 100 AS Distance_from_low, {d("close - Recent_low_20", "Recent_high_20 - Recent_low_20")} AS Price_position_20,
  {full(10, "ret", "stddev_samp(ret) OVER w10")} * sqrt(252) AS Price_volatility_10,
  {full(20, "ret", "stddev_samp(ret) OVER w20")} * sqrt(252) AS Price_volatility_20, avg(tr) OVER w14 AS ATR_14 FROM p0 {wins(10, 14, 20)}),
res AS (SELECT *, {d("Price_volatility_10", "Price_volatility_20")} AS Volatility_ratio, ATR_14 / close * 100 AS ATR_normalized FROM p1)"""


@query(
    "price_momentum",
    Shape(
        ["symbol"], ["ts"], ["Gap_up", "Gap_down", "Higher_high", "Lower_low"],
        [
            "ROC_1", "ROC_5", "ROC_10", "ROC_20", "Momentum_5_normalized", "Momentum_10_normalized", "Momentum_20_normalized", "Returns_acceleration",
            "Price_volatility_10", "Price_volatility_20", "Volatility_ratio", "ATR_normalized", "Distance_from_high", "Distance_from_low",
            "Price_position_20", "Trend_strength_10",
        ],
        ["Momentum_5", "Momentum_10", "Momentum_20", "Price_acceleration", "ATR_14", "Recent_high_20", "Recent_low_20"],
    ),
    f"{BARS},{_momentum_sql('bars')}",
)
def price_momentum(spark, sf):
    return ind.add_price_momentum(fx.bars(spark, sf))


# ------------------------------------------------------------ whole sets
_u_smas = (5, 10, 20, 50, 200)
_unified_sql = f"""{BARS}, {_steps},
u0 AS (SELECT *, close / lag(close) OVER w - 1 AS u_returns, ln(close / lag(close) OVER w) AS u_log_returns,
  {", ".join(f"{full(n, 'close', f'avg(close) OVER w{n}')} AS u_sma_{n}" for n in _u_smas)},
  {full(20, "close", "avg(close) OVER w20")} AS u_bb_middle, {full(20, "close", "stddev_samp(close) OVER w20")} AS sd,
  {full(14, "close", "(" + rsi(14) + ")")} AS u_rsi, {full(10, "volume", "avg(volume) OVER w10")} AS u_volume_sma_10,
  close * volume AS u_price_volume FROM g {wins(5, 10, 14, 20, 50, 200)}),
{ema_chain("u0", {"u_ema_12": ("close", 12), "u_ema_26": ("close", 26)}, "u1")},
u2 AS (SELECT *, u_ema_12 - u_ema_26 AS u_macd FROM u1),{ema_chain("u2", {"u_macd_signal": ("u_macd", 9)}, "u3")},
res AS (SELECT *, u_macd - u_macd_signal AS u_macd_diff, u_bb_middle + 2 * sd AS u_bb_upper, u_bb_middle - 2 * sd AS u_bb_lower,
  4 * sd AS u_bb_width, {d("close - (u_bb_middle - 2 * sd)", "4 * sd")} AS u_bb_position, {d("volume", "u_volume_sma_10")} AS u_volume_ratio,
  {", ".join(f"{d('close', f'u_sma_{n}')} AS u_sma_{n}_ratio" for n in _u_smas)} FROM u3)"""


@query(
    "unified_indicators",
    Shape(
        ["symbol"], ["ts"], [],
        ["u_returns", "u_log_returns", "u_bb_position", "u_rsi", "u_volume_ratio", *[f"u_sma_{n}_ratio" for n in _u_smas]],
        [
            *[f"u_sma_{n}" for n in _u_smas], "u_ema_12", "u_ema_26", "u_macd", "u_macd_signal", "u_macd_diff", "u_bb_middle", "u_bb_upper",
            "u_bb_lower", "u_bb_width", "u_volume_sma_10", "u_price_volume",
        ],
    ),
    _unified_sql,
)
def unified_indicators(spark, sf):
    return ind.apply_waves(fx.bars(spark, sf), ind.DAILY, ind.unified_indicators())


_regime_sql = f"""
r0 AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM bars {wins()}),
r1 AS (SELECT *, {full(20, "ret", "stddev_samp(ret) OVER w20")} * sqrt(252) AS volatility_20d,
  {full(60, "ret", "stddev_samp(ret) OVER w60")} * sqrt(252) AS volatility_60d,
  {d("abs(" + full(20, "close", "avg(close) OVER w20") + " - " + full(50, "close", "avg(close) OVER w50") + ")", full(20, "close", "stddev_samp(close) OVER w20"))} AS trend_strength
  FROM r0 {wins(20, 50, 60)}),
res AS (SELECT *, {d("volatility_20d", "volatility_60d")} AS volatility_ratio,
  {fl("volatility_20d > " + full(252, "volatility_20d", "avg(volatility_20d) OVER w252 + stddev_samp(volatility_20d) OVER w252"))} AS high_volatility
  FROM r1 {wins(252)})"""


@query(
    "market_regime",
    Shape(["symbol"], ["ts"], ["high_volatility"], ["volatility_20d", "volatility_60d", "volatility_ratio", "trend_strength"]),
    f"{BARS},{_regime_sql}",
)
def market_regime(spark, sf):
    return ind.apply_waves(fx.bars(spark, sf), ind.DAILY, ind.market_regime())


_SAMPLE = ["MACD", "SMA_50", "EMA_26", "WMA_20", "BB_upper_20", "VWAP", "ATR_14"]
_SAMPLE_FINE = ["RSI_14", "CCI", "Stoch_D", "Williams_R", "ROC_10", "Volatility_ratio", "Trend_strength_10"]


def _last_known(cols):
    """The 'reference' fill: forward, then backward, then 0."""
    return ", ".join(
        f"""coalesce(last_value({c} IGNORE NULLS) OVER cum,
          first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}"""
        for c in cols
    )


_all_sql = f"""{BARS}, {_steps},{ema_chain("g", {"EMA_26": ("close", 26), "e12": ("close", 12)}, "a0")},
a1 AS (SELECT *, e12 - EMA_26 AS MACD, (high + low + close) / 3 AS tp, close / lag(close) OVER w - 1 AS ret,
  max(high) OVER w14 AS hh, min(low) OVER w14 AS ll, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM a0 {wins(14)}),
a2 AS (SELECT *, avg(close) OVER w50 AS SMA_50, {_wma(20)} AS WMA_20, avg(close) OVER w20 + 2 * stddev_samp(close) OVER w20 AS BB_upper_20,
  sum((high + low + close) * volume) OVER cum / NULLIF(3 * sum(volume) OVER cum, 0) AS VWAP, avg(tr) OVER w14 AS ATR_14, {rsi(14)} AS RSI_14,
  avg(tp) OVER w20 AS tpm, list(tp) OVER w20 AS tpl, {d("close - ll", "hh - ll")} * 100 AS sk, {d("hh - close", "hh - ll")} * -100 AS Williams_R,
  {d("close - lag(close, 10) OVER w", "lag(close, 10) OVER w")} * 100 AS ROC_10,
  {d(full(10, "ret", "stddev_samp(ret) OVER w10"), full(20, "ret", "stddev_samp(ret) OVER w20"))} AS Volatility_ratio,
  {d("close - lag(close, 10) OVER w", full(10, "close", "stddev_samp(close) OVER w10"))} AS Trend_strength_10 FROM a1 {wins(10, 14, 20, 50)}),
a3 AS (SELECT *, {d("tp - tpm", "0.015 * list_avg(list_transform(tpl, lambda x: abs(x - tpm)))")} AS CCI, avg(sk) OVER w3 AS Stoch_D FROM a2 {wins(3)}),
res AS (SELECT symbol, ts, {_last_known(_SAMPLE + _SAMPLE_FINE)} FROM a3 {wins()})"""


@query("all_indicators_filled", Shape(["symbol"], ["ts"], [], _SAMPLE_FINE, _SAMPLE), _all_sql)
def all_indicators_filled(spark, sf):
    return ind.technical_indicators(fx.bars(spark, sf), fill="reference")


@query(
    "exogenous_features",
    Shape(["symbol"], ["ts"], [], ["volume_ratio", "volatility", "volatility_ma", "rsi", "bb_position"], ["volume_ma"]),
    f"""{BARS}, {_steps},
x0 AS (SELECT *, close / lag(close) OVER w - 1 AS ret, {full(20, "volume", "avg(volume) OVER w20")} AS vm, {full(14, "close", "(" + rsi(14) + ")")} AS rsi0,
  {d("close - " + full(20, "close", "avg(close) OVER w20"), "2 * stddev_samp(close) OVER w20")} AS bp FROM g {wins(14, 20)}),
x1 AS (SELECT *, {full(20, "ret", "stddev_samp(ret) OVER w20")} AS vol0, {d("volume", "vm")} AS vr FROM x0 {wins(20)}),
x2 AS (SELECT *, {full(5, "vol0", "avg(vol0) OVER w5")} AS vma FROM x1 {wins(5)}),
res AS (SELECT symbol, ts, {", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER cum, 0.0) AS {n}" for c, n in (("vm", "volume_ma"), ("vr", "volume_ratio"), ("vol0", "volatility"), ("vma", "volatility_ma"), ("rsi0", "rsi"), ("bp", "bb_position")))}
  FROM x2 {wins()})""",
)
def exogenous_features(spark, sf):
    return ind.exogenous_features(fx.bars(spark, sf))


@query(
    "candle_direction",
    Shape(["symbol"], ["ts"], ["direction"], [], ["open", "close"]),
    f"{BARS}, res AS (SELECT *, CASE WHEN close < open THEN 'down' ELSE 'up' END AS direction FROM bars)",
)
def candle_direction(spark, sf):
    return ind.candle_direction(fx.bars(spark, sf))


# ------------------------------------------------------------ heavy keys: ticks and order book
_T_ORDER = "ts, event_id"
BLOCK = 200_000


@query(
    "tick_indicators",
    Shape(
        ["symbol"], [], ["event_id", "MA_golden_cross", "OBV_trend"], ["SMA_200_ratio", "VWAP_distance", "RSI_14"],
        ["SMA_20", "SMA_200", "EMA_26", "OBV", "VWAP", "AD_line", "Recent_high_20"],
    ),
    f"""{fx.TICKS_SQL},
tk AS (SELECT * EXCLUDE (ts), row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS ts FROM ticks),
g AS (SELECT *, {_moves} FROM (SELECT *, close - lag(close) OVER w AS x FROM tk {wins()})),
{ema_chain("g", {"EMA_26": ("close", 26)}, "t0")},
t1 AS (SELECT *, avg(close) OVER w20 AS SMA_20, avg(close) OVER w50 AS SMA_50, avg(close) OVER w200 AS SMA_200, {rsi(14)} AS RSI_14,
  sum(volume * {sg("x")}) OVER cum AS OBV, sum((high + low + close) * volume) OVER cum / (3 * sum(volume) OVER cum) AS VWAP,
  sum(coalesce({d("(close - low) - (high - close)", "high - low")}, 0) * volume) OVER cum AS AD_line,
  {full(20, "close", "max(close) OVER w20")} AS Recent_high_20 FROM t0 {wins(14, 20, 50, 200)}),
res AS (SELECT *, {d("close", "SMA_200")} AS SMA_200_ratio, (close - VWAP) / VWAP * 100 AS VWAP_distance, {fl("SMA_20 > SMA_50")} AS MA_golden_cross,
  CASE WHEN lag(OBV, 9) OVER w IS NOT NULL THEN {sg("(OBV - lag(OBV, 9) OVER w)")} END AS OBV_trend FROM t1 {wins()})""",
)
def tick_indicators(spark, sf):
    def features(df, axis):
        return ind.apply_waves(
            df, axis, ind.moving_averages(axis, sma=(20, 50, 200), ema=(26,), wma=()), ind.rsi(axis, periods=(14,)),
            ind.volume_indicators(axis), ind.price_momentum(axis),
        )

    return in_blocks(fx.ticks(spark, sf), fx.TICKS, features, before=2 * ind.HISTORY, rows_per_block=BLOCK)


@query(
    "microstructure",
    Shape(["symbol"], [], ["event_id"], ["micro_spread_pct", "micro_mid_return", "micro_quote_imbalance"], ["micro_mid_price"]),
    f"""{fx.BOOK_SQL},
m AS (SELECT *, (bid_price_1 + ask_price_1) / 2 AS micro_mid_price FROM book),
res AS (SELECT *, {d("ask_price_1 - bid_price_1", "micro_mid_price")} AS micro_spread_pct,
  ln(micro_mid_price) - ln(lag(micro_mid_price) OVER w) AS micro_mid_return,
  (bid_size_1 - ask_size_1) / (bid_size_1 + ask_size_1 + 1e-8) AS micro_quote_imbalance FROM m {wins(order="ts, event_id")})""",
)
def microstructure(spark, sf):
    return in_blocks(fx.book(spark, sf), fx.TICKS, micro.microstructure, before=1, rows_per_block=BLOCK)


_bid = "(bid_price_1 * bid_size_1 + bid_price_2 * bid_size_2 + bid_price_3 * bid_size_3) / (bid_size_1 + bid_size_2 + bid_size_3 + 1e-8)"
_ask = "(ask_price_1 * ask_size_1 + ask_price_2 * ask_size_2 + ask_price_3 * ask_size_3) / (ask_size_1 + ask_size_2 + ask_size_3 + 1e-8)"


@query(
    "order_book_levels",
    Shape(["symbol"], [], ["event_id"], ["ob_spread_wap"], ["ob_mid_price_wap", "ob_total_volume"]),
    f"""{fx.BOOK_SQL},
b AS (SELECT *, {_bid} AS bw, {_ask} AS aw FROM book),
res AS (SELECT *, (bw + aw) / 2 AS ob_mid_price_wap, {d("aw - bw", "(bw + aw) / 2")} AS ob_spread_wap,
  bid_size_1 + bid_size_2 + bid_size_3 + ask_size_1 + ask_size_2 + ask_size_3 AS ob_total_volume FROM b)""",
)
def order_book_levels(spark, sf):
    return micro.aggregate_levels(fx.book(spark, sf), depth=3)
