"""Technical indicators over price bars.

Each family returns waves (see ``functions.axis``); ``technical_indicators``
overlays all of them so the whole feature set costs one shuffle and one sort.
``add_*`` functions apply a single family.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import DAILY, Axis, Scan, Wave, apply_waves, by_size, delayed, stacked
from ..functions.exprs import NUMERIC, div, finite, flag, full, sign, total
from ..functions.recursive import ewm, reach
from ..functions.rolling import chained_moments, quantile_of_sorted, rolling_means, rolling_moments
from . import clean

C = F.col
YEAR = math.sqrt(252)


def _require(df: DataFrame, *names: str) -> None:
    gone = [n for n in names if n not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {gone}")


# ------------------------------------------------------------ moving averages


def moving_averages(
    axis: Axis = DAILY,
    price: str = "close",
    sma: Sequence[int] = (5, 10, 20, 50, 100, 200),
    ema: Sequence[int] = (12, 26, 50),
    wma: Sequence[int] = (10, 20),
) -> list[Wave]:
    p = C(price)
    simple = rolling_means(p, axis, {n: f"SMA_{n}" for n in sma}, tag="sma") if sma else [{}, {}, {}]
    means: Wave = {}
    for n in wma:
        # weight n for the newest row down to 1 for the oldest; NULL until n rows exist
        means[f"WMA_{n}"] = total([(p if k == 0 else axis.lag(p, k)) * (n - k) for k in range(n)]) / (n * (n + 1) / 2)
    ratios: Wave = {}
    for n in sma:
        ratios[f"SMA_{n}_ratio"] = div(p, f"SMA_{n}")
        ratios[f"SMA_{n}_distance"] = div(p - C(f"SMA_{n}"), f"SMA_{n}") * 100
    for n in wma:
        ratios[f"WMA_{n}_ratio"] = div(p, f"WMA_{n}")
    if {20, 50} <= set(sma):
        ratios["MA_golden_cross"] = flag(C("SMA_20") > C("SMA_50"))
        ratios["MA_death_cross"] = flag(C("SMA_20") < C("SMA_50"))
    recursive = stacked(*[ewm(f"EMA_{n}", p, axis, n) for n in ema]) if ema else [{}]
    tail: Wave = {}
    for n in ema:
        tail[f"EMA_{n}_ratio"] = div(p, f"EMA_{n}")
        tail[f"EMA_{n}_distance"] = div(p - C(f"EMA_{n}"), f"EMA_{n}") * 100
    if {12, 26} <= set(ema):
        tail["EMA_bull_signal"] = flag(C("EMA_12") > C("EMA_26"))
        tail["EMA_bear_signal"] = flag(C("EMA_12") < C("EMA_26"))
    return stacked(simple, delayed([means, ratios], 2), [*recursive, tail])


# ------------------------------------------------------------ oscillators


def _rsi_value(gain: Column, loss: Column) -> Column:
    # all gain, no loss: 100; no movement at all: undefined
    return F.when((loss == 0) & (gain > 0), 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(gain, loss)))


def rsi(
    axis: Axis = DAILY,
    price: str = "close",
    periods: Sequence[int] = (14, 21, 30),
    overbought: float = 70,
    oversold: float = 30,
) -> list[Wave]:
    step = axis.diff(price)
    moves: Wave = {
        "_t_gain": F.when(step > 0, step).otherwise(0.0),
        "_t_loss": F.when(step < 0, -step).otherwise(0.0),
    }
    values: Wave = {
        f"RSI_{n}": _rsi_value(F.avg("_t_gain").over(axis.last(n)), F.avg("_t_loss").over(axis.last(n))) for n in periods
    }
    derived: Wave = {}
    for n in periods:
        r = C(f"RSI_{n}")
        derived[f"RSI_{n}_overbought"] = flag(r > overbought)
        derived[f"RSI_{n}_oversold"] = flag(r < oversold)
        derived[f"RSI_{n}_normalized"] = (r - 50) / 50
        derived[f"RSI_{n}_momentum"] = axis.diff(r)
        derived[f"RSI_{n}_trend"] = sign(axis.diff(r))
    if 14 in periods:
        p, p5, r, r5 = C(price), axis.lag(price, 5), C("RSI_14"), axis.lag("RSI_14", 5)
        derived["RSI_bullish_divergence"] = F.coalesce((p < p5) & (r > r5), F.lit(False))
        derived["RSI_bearish_divergence"] = F.coalesce((p > p5) & (r < r5), F.lit(False))
    return [moves, values, derived]


def macd(axis: Axis = DAILY, price: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> list[Wave]:
    base = stacked(ewm("_t_macd_fast", price, axis, fast), ewm("_t_macd_slow", price, axis, slow))
    line: Wave = {"MACD": C("_t_macd_fast") - C("_t_macd_slow")}
    smooth = ewm("MACD_signal", "MACD", axis, signal)
    m, s = C("MACD"), C("MACD_signal")
    pm, ps = axis.lag(m), axis.lag(s)
    end: list[Wave] = [
        {
            "MACD_histogram": m - s,
            "MACD_bullish_crossover": flag((m > s) & (pm <= ps)),
            "MACD_bearish_crossover": flag((m < s) & (pm >= ps)),
            "MACD_zero_cross_up": flag((m > 0) & (pm <= 0)),
            "MACD_zero_cross_down": flag((m < 0) & (pm >= 0)),
            "MACD_momentum": axis.diff(m),
            "MACD_normalized": div(m, price) * 100,
            "MACD_histogram_momentum": (m - s) - (pm - ps),
        }
    ]
    return [*base, line, *smooth, *end]


def bollinger(
    axis: Axis = DAILY, price: str = "close", period: int = 20, width: float = 2.0, extra: Sequence[float] = (1.0, 2.5)
) -> list[Wave]:
    p, n = C(price), period
    mid, sd = C(f"BB_middle_{n}"), C("_t_bb_sd")
    up, low, wn = C(f"BB_upper_{n}"), C(f"BB_lower_{n}"), C(f"BB_width_normalized_{n}")
    base: Wave = {f"BB_middle_{n}": F.avg(p).over(axis.last(n)), "_t_bb_sd": F.stddev_samp(p).over(axis.last(n))}
    bands: Wave = {f"BB_upper_{n}": mid + width * sd, f"BB_lower_{n}": mid - width * sd}
    for k in extra:
        label = str(float(k)).replace(".", "_")  # a dot in a Spark column name would need quoting everywhere
        bands[f"BB_upper_{n}_{label}"] = mid + k * sd
        bands[f"BB_lower_{n}_{label}"] = mid - k * sd
    spread: Wave = {
        f"BB_width_{n}": up - low,
        f"BB_width_normalized_{n}": div(up - low, mid),
        f"BB_position_{n}": div(p - low, up - low),
        f"BB_percent_b_{n}": div(p - low, up - low),
        f"BB_upper_distance_{n}": div(up - p, p) * 100,
        f"BB_lower_distance_{n}": div(p - low, p) * 100,
        f"BB_upper_touch_{n}": flag(p >= up),
        f"BB_lower_touch_{n}": flag(p <= low),
    }
    frame: Wave = {"_t_bb_sorted": F.sort_array(F.collect_list(wn).over(axis.last(50)))}
    narrow = F.when(F.size("_t_bb_sorted") == 50, quantile_of_sorted("_t_bb_sorted", 50, 0.2))
    return [base, bands, spread, frame, {f"BB_squeeze_{n}": flag(wn < narrow)}]


# ------------------------------------------------------------ volume


def volume_indicators(
    axis: Axis = DAILY,
    price: str = "close",
    volume: str = "volume",
    high: str | None = "high",
    low: str | None = "low",
    periods: Sequence[int] = (10, 20, 50),
) -> list[Wave]:
    p, v = C(price), C(volume)
    w0: Wave = {f"Volume_SMA_{n}": F.avg(v).over(axis.last(n)) for n in sorted({*periods, 10, 20})}
    w0["_t_obv"] = v * sign(axis.diff(p))
    w0["_t_pvt"] = v * axis.pct(p)
    w0["Volume_momentum"] = axis.pct(v)
    w1: Wave = {f"Volume_ratio_{n}": div(v, f"Volume_SMA_{n}") for n in periods}
    w1["OBV"] = Scan("sum", C("_t_obv"))
    w1["PVT"] = Scan("sum", C("_t_pvt"))
    w1["Volume_oscillator"] = div(C("Volume_SMA_10") - C("Volume_SMA_20"), "Volume_SMA_20") * 100
    w1["Volume_spike"] = flag(v > C("Volume_SMA_20") * 2)
    w1["Volume_dry_up"] = flag(v < C("Volume_SMA_20") * 0.5)
    w1["Volume_acceleration"] = axis.diff("Volume_momentum")
    w2: Wave = {"OBV_trend": F.signum(C("OBV") - axis.lag("OBV", 9)).cast("int")}
    families = [[w0, w1, w2], delayed(ewm("PVT_signal", "PVT", axis, 9, adjust=True), 2)]
    if high and low:
        h, lo = C(high), C(low)
        clv = F.coalesce(div((p - lo) - (h - p), h - lo), F.lit(0.0))
        families.append(
            [
                {"_t_tpv": (h + lo + p) * v, "_t_clv": clv * v},
                {"_t_tpv_sum": Scan("sum", C("_t_tpv")), "_t_v_sum": Scan("sum", v), "AD_line": Scan("sum", C("_t_clv"))},
                {"VWAP": div("_t_tpv_sum", 3 * C("_t_v_sum"))},
                {"VWAP_distance": div(p - C("VWAP"), "VWAP") * 100},
            ]
        )
    return stacked(*families)


# ------------------------------------------------------------ momentum and patterns


def price_momentum(axis: Axis = DAILY, price: str = "close", high: str | None = "high", low: str | None = "low") -> list[Wave]:
    p = C(price)
    p1, p2 = axis.lag(p), axis.lag(p, 2)
    w0: Wave = {}
    for n in (1, 5, 10, 20):
        w0[f"ROC_{n}"] = div(axis.diff(p, n), axis.lag(p, n)) * 100
    for n in (5, 10, 20):
        w0[f"Momentum_{n}"] = axis.diff(p, n)
        w0[f"Momentum_{n}_normalized"] = div(axis.diff(p, n), p) * 100
    w0["Price_acceleration"] = p - 2 * p1 + p2
    w0["_t_ret"] = axis.pct(p)
    w0["Recent_high_20"] = full(20, p, axis.last(20), F.max(p).over(axis.last(20)))
    w0["Recent_low_20"] = full(20, p, axis.last(20), F.min(p).over(axis.last(20)))
    w0["Trend_strength_10"] = div(axis.diff(p, 10), full(10, p, axis.last(10), F.stddev_samp(p).over(axis.last(10))))
    w0["Gap_up"] = flag(p > p1 * 1.02)
    w0["Gap_down"] = flag(p < p1 * 0.98)
    w0["Higher_high"] = flag((p > p1) & (p1 > p2))
    w0["Lower_low"] = flag((p < p1) & (p1 < p2))
    hi, lo = C("Recent_high_20"), C("Recent_low_20")
    w1: Wave = {
        "Returns_acceleration": axis.diff("_t_ret"),
        "Distance_from_high": div(hi - p, p) * 100,
        "Distance_from_low": div(p - lo, p) * 100,
        "Price_position_20": div(p - lo, hi - lo),
    }
    for n in (10, 20):
        w1[f"Price_volatility_{n}"] = full(n, "_t_ret", axis.last(n), F.stddev_samp("_t_ret").over(axis.last(n))) * YEAR
    w2: Wave = {"Volatility_ratio": div("Price_volatility_10", "Price_volatility_20")}
    if high and low:
        h, l_ = C(high), C(low)
        w0["_t_tr"] = F.greatest(h - l_, F.abs(h - p1), F.abs(l_ - p1))
        w1["ATR_14"] = F.avg("_t_tr").over(axis.last(14))
        w2["ATR_normalized"] = div("ATR_14", p) * 100
    return [w0, w1, w2]


def stochastic(axis: Axis = DAILY, price: str = "close", high: str = "high", low: str = "low", k: int = 14, d: int = 3) -> list[Wave]:
    w0: Wave = {"_t_hh": F.max(high).over(axis.last(k)), "_t_ll": F.min(low).over(axis.last(k))}
    w1: Wave = {"Stoch_K": div(C(price) - C("_t_ll"), C("_t_hh") - C("_t_ll")) * 100}
    w2: Wave = {
        "Stoch_D": F.avg("Stoch_K").over(axis.last(d)),
        "Stoch_overbought": flag(C("Stoch_K") > 80),
        "Stoch_oversold": flag(C("Stoch_K") < 20),
    }
    return [w0, w1, w2]


def williams_r(axis: Axis = DAILY, price: str = "close", high: str = "high", low: str = "low", n: int = 14) -> list[Wave]:
    hh, ll = F.max(high).over(axis.last(n)), F.min(low).over(axis.last(n))
    return [
        {"_t_whh": hh, "_t_wll": ll},
        {"Williams_R": div(C("_t_whh") - C(price), C("_t_whh") - C("_t_wll")) * -100},
        {"Williams_R_overbought": flag(C("Williams_R") > -20), "Williams_R_oversold": flag(C("Williams_R") < -80)},
    ]


def cci(axis: Axis = DAILY, price: str = "close", high: str = "high", low: str = "low", n: int = 20) -> list[Wave]:
    tp, mean = C("_t_tp"), C("_t_tp_mean")
    frame = F.collect_list(tp).over(axis.last(n))
    spread = F.aggregate(C("_t_tp_frame"), F.lit(0.0), lambda acc, x: acc + F.abs(x - mean)) / F.size("_t_tp_frame")
    return [
        {"_t_tp": (C(high) + C(low) + C(price)) / 3},
        {"_t_tp_mean": F.avg(tp).over(axis.last(n)), "_t_tp_frame": frame},
        {"CCI": div(tp - mean, 0.015 * spread)},
        {"CCI_overbought": flag(C("CCI") > 100), "CCI_oversold": flag(C("CCI") < -100)},
    ]


# ------------------------------------------------------------ whole sets

#: rows of history the longest feature of ``technical_indicators`` looks at
HISTORY = reach(50) + 1


def _fill_features(df: DataFrame, axis: Axis, names: Sequence[str], fill: str) -> DataFrame:
    """'reference' fills forward, then backward (looks ahead), then 0; 'forward' never looks ahead."""
    kinds = {f.name: f.dataType for f in df.schema}
    names = [n for n in names if isinstance(kinds[n], NUMERIC)]
    sparse = [n for n in names if kinds[n].typeName() == "double"]
    df = df.withColumns({n: finite(n) for n in sparse})
    df = clean.fill_both(df, sparse, axis) if fill == "reference" else clean.forward_fill(df, sparse, axis)
    return df.withColumns({n: F.coalesce(C(n), F.lit(0)) for n in names})


def technical_indicators(
    df: DataFrame,
    axis: Axis = DAILY,
    price: str = "close",
    volume: str = "volume",
    high: str = "high",
    low: str = "low",
    advanced: bool = True,
    fill: str = "none",
) -> DataFrame:
    """Every indicator family in one pass; ``fill`` is 'none', 'forward' or 'reference'."""
    _require(df, price, volume, high, low)
    families = [
        moving_averages(axis, price),
        rsi(axis, price),
        macd(axis, price),
        bollinger(axis, price),
        volume_indicators(axis, price, volume, high, low),
        price_momentum(axis, price, high, low),
    ]
    if advanced:
        families += [stochastic(axis, price, high, low), williams_r(axis, price, high, low), cci(axis, price, high, low)]
    given = set(df.columns)
    out = apply_waves(df, axis, *families)
    if fill == "none":
        return out
    return _fill_features(out, axis, [c for c in out.columns if c not in given], fill)


def technical_indicators_any_length(df: DataFrame, axis: Axis, longest: int = 2_000_000, rows_per_block: int = 200_000, **kw) -> DataFrame:
    """The same features for series of any length, such as ticks under one heavy key; the layout follows the data."""
    return by_size(df, axis, lambda d, a: technical_indicators(d, a, **kw), before=2 * HISTORY, longest=longest, rows_per_block=rows_per_block)


def _adder(family: Callable[..., list[Wave]]) -> Callable[..., DataFrame]:
    def add(df: DataFrame, axis: Axis = DAILY, **kw) -> DataFrame:
        return apply_waves(df, axis, family(axis, **kw))

    add.__doc__ = f"Add the ``{family.__name__}`` columns."
    return add


add_moving_averages = _adder(moving_averages)
add_rsi = _adder(rsi)
add_macd = _adder(macd)
add_bollinger = _adder(bollinger)
add_volume_indicators = _adder(volume_indicators)
add_price_momentum = _adder(price_momentum)
add_stochastic = _adder(stochastic)
add_williams_r = _adder(williams_r)
add_cci = _adder(cci)


# ------------------------------------------------------------ full-window variants


def unified_indicators(axis: Axis = DAILY, price: str = "close", volume: str | None = "volume", prefix: str = "u_") -> list[Wave]:
    """The merged-dataset indicator set: same ideas, but NULL until a window is full.

    Names carry a prefix because Spark column names ignore case and the two
    sets would otherwise collide (SMA_20 and sma_20).
    """
    p, q = C(price), prefix
    step = axis.diff(p)
    w0: Wave = {
        f"{q}returns": axis.pct(p),
        f"{q}log_returns": F.ln(div(p, axis.lag(p))),
        f"_t_{q}gain": F.when(step > 0, step).otherwise(0.0),
        f"_t_{q}loss": F.when(step < 0, -step).otherwise(0.0),
    }
    simple = rolling_means(p, axis, {**{n: f"{q}sma_{n}" for n in (5, 10, 20, 50, 200)}, 14: f"_t_{q}m14"}, "full", tag="u")
    spread = chained_moments(p, axis, (5, 20), {20: (None, f"_t_{q}sd")}, tag="u")
    moves = stacked(*[rolling_means(f"_t_{q}{c}", axis, {14: f"_t_{q}{c}14"}, tag=f"u{c}") for c in ("gain", "loss")])
    mid, sd = C(f"{q}sma_20"), C(f"_t_{q}sd")
    bands: Wave = {
        f"{q}bb_middle": mid,
        f"{q}bb_upper": mid + 2 * sd,
        f"{q}bb_lower": mid - 2 * sd,
        f"{q}bb_width": 4 * sd,
        f"{q}bb_position": div(p - (mid - 2 * sd), 4 * sd),
        f"{q}rsi": F.when(C(f"_t_{q}m14").isNotNull(), _rsi_value(C(f"_t_{q}gain14"), C(f"_t_{q}loss14"))),
    }
    families: list[list[Wave]] = []
    ratios: Wave = {f"{q}sma_{n}_ratio": div(p, f"{q}sma_{n}") for n in (5, 10, 20, 50, 200)}
    if volume:
        v = C(volume)
        w0[f"{q}price_volume"] = p * v
        families.append([*rolling_means(v, axis, {10: f"{q}volume_sma_10"}, "full", tag="uv"), {f"{q}volume_ratio": div(v, f"{q}volume_sma_10")}])
    emas = stacked(ewm(f"{q}ema_12", p, axis, 12), ewm(f"{q}ema_26", p, axis, 26))
    tail = [
        {f"{q}macd": C(f"{q}ema_12") - C(f"{q}ema_26")},
        *ewm(f"{q}macd_signal", f"{q}macd", axis, 9),
        {f"{q}macd_diff": C(f"{q}macd") - C(f"{q}macd_signal")},
    ]
    return stacked(simple, delayed([ratios], 3), [w0], delayed(moves, 1), spread, delayed([bands], len(spread)), [*emas, *tail], *families)


def market_regime(axis: Axis = DAILY, price: str = "close", returns: str | None = None) -> list[Wave]:
    """Volatility and trend regimes; ``returns`` names an existing column or is derived."""
    p = C(price)
    first: list[Wave] = [] if returns else [{"_t_reg_ret": axis.pct(p)}]
    r = C(returns or "_t_reg_ret")
    means = rolling_means(p, axis, {20: "_t_reg_m20", 50: "_t_reg_m50"}, "full", tag="reg")
    v20 = C("volatility_20d")
    moments = chained_moments(r, axis, (5, 20, 60), {20: (None, "_t_reg_v20"), 60: (None, "_t_reg_v60")}, tag="regr")
    spread = chained_moments(p, axis, (5, 20), {20: (None, "_t_reg_sd")}, tag="regp")
    base: Wave = {"volatility_20d": C("_t_reg_v20") * YEAR, "volatility_60d": C("_t_reg_v60") * YEAR}
    ratio: Wave = {"volatility_ratio": div("volatility_20d", "volatility_60d")}
    strength: Wave = {"trend_strength": div(F.abs(C("_t_reg_m20") - C("_t_reg_m50")), "_t_reg_sd")}
    long_run = rolling_moments(v20, axis, 252, "_t_reg_lm", "_t_reg_ls", tag="reg")
    high: Wave = {"high_volatility": flag(v20 > C("_t_reg_lm") + C("_t_reg_ls"))}
    daily = [*first, *moments, base, ratio]
    return stacked(daily, delayed([*long_run, high], len(daily) - 1), means, spread, delayed([strength], len(spread)))


def exogenous_features(df: DataFrame, axis: Axis = DAILY, price: str = "close", volume: str | None = "volume") -> DataFrame:
    """Regressors for the per-series forecasters, filled forward and then with 0."""
    p = C(price)
    w14, w20 = axis.last(14), axis.last(20)
    step = axis.diff(p)
    names = ["volatility", "volatility_ma", "rsi", "bb_position"]
    w0: Wave = {
        "_t_x_ret": axis.pct(p),
        "_t_x_gain": F.when(step > 0, step).otherwise(0.0),
        "_t_x_loss": F.when(step < 0, -step).otherwise(0.0),
        "_t_x_mid": full(20, p, w20, F.avg(p).over(w20)),
        "_t_x_sd": full(20, p, w20, F.stddev_samp(p).over(w20)),
    }
    mid, sd = C("_t_x_mid"), C("_t_x_sd")
    w1: Wave = {
        "volatility": full(20, "_t_x_ret", w20, F.stddev_samp("_t_x_ret").over(w20)),
        "rsi": full(14, p, w14, _rsi_value(F.avg("_t_x_gain").over(w14), F.avg("_t_x_loss").over(w14))),
        "bb_position": div(p - mid, 2 * sd),
    }
    if volume:
        v = C(volume)
        names += ["volume_ma", "volume_ratio"]
        w0["volume_ma"] = full(20, v, w20, F.avg(v).over(w20))
        w1["volume_ratio"] = div(v, "volume_ma")
    vol = C("volatility")
    w2: Wave = {"volatility_ma": full(5, vol, axis.last(5), F.avg(vol).over(axis.last(5)))}
    w3: Wave = {n: Scan("last", C(n)) for n in names}
    out = apply_waves(df, axis, [w0, w1, w2, w3])
    return out.withColumns({n: F.coalesce(C(n), F.lit(0.0)) for n in names})


def candle_direction(df: DataFrame, open_: str = "open", close: str = "close") -> DataFrame:
    return df.withColumn("direction", F.when(C(close) < C(open_), "down").otherwise("up"))
