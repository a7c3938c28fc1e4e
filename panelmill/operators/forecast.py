"""Targets, training windows and per-series forecasters."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import smoothing
from ..functions.axis import DAILY, Axis
from ..functions.exprs import div
from . import calendar as cal
from .evaluate import rank_models

C = F.col
FOLDS = 128  # folds of a series that one row holds


# ------------------------------------------------------------ targets and windows


def forward_return(df: DataFrame, horizon: int = 1, axis: Axis = DAILY, price: str = "close", out: str = "target") -> DataFrame:
    """Return over the next ``horizon`` rows; the last rows stay NULL."""
    return df.withColumn(out, div(axis.lead(price, horizon), price) - 1)


def training_windows(df: DataFrame, features: Sequence[str], context: int, horizon: int, axis: Axis = DAILY, price: str = "close") -> DataFrame:
    """Per row: the ``context`` feature rows before it and the return path from it on.

    ``path[k]`` is the return of the k-th row from here on the last context
    price.  Rows without a full context or horizon are left out.
    """
    w = axis.by_time()
    ahead = w.rowsBetween(0, horizon - 1)
    cols = {
        "window": F.collect_list(F.array(*[C(f).cast("double") for f in features])).over(w.rowsBetween(-context, -1)),
        "_t_path": F.collect_list(price).over(ahead),
        "_t_base": axis.lag(price),
    }
    out = df.withColumns(cols).filter((F.size("window") == context) & (F.size("_t_path") == horizon))
    return out.withColumn("path", F.transform("_t_path", lambda p: p / C("_t_base") - 1)).drop("_t_path", "_t_base")


def horizon_windows(df: DataFrame, features: Sequence[str], context: int, horizon: int, axis: Axis = DAILY, price: str = "close") -> DataFrame:
    """``context`` rows ending before each row, and the single return ``horizon`` rows on."""
    base = F.collect_list(F.array(*[C(f).cast("double") for f in features])).over(axis.by_time().rowsBetween(-context, -1))
    out = df.withColumns({"window": base, "target": div(axis.lead(price, horizon), price) - 1})
    return out.filter((F.size("window") == context) & C("target").isNotNull())


def price_windows(df: DataFrame, context: int, horizon: int, axis: Axis = DAILY, price: str = "close") -> DataFrame:
    """Overlapping runs of ``context + horizon`` prices, one per starting row."""
    n = context + horizon
    run = F.collect_list(price).over(axis.by_time().rowsBetween(0, n - 1))
    return df.withColumn("prices", run).filter(F.size("prices") == n)


def long_format(df: DataFrame, axis: Axis = DAILY, value: str = "close") -> DataFrame:
    return df.select(F.concat_ws("/", *axis.key).alias("unique_id"), C(axis.ts).alias("ds"), C(value).alias("y"))


# ------------------------------------------------------------ closed-form forecasts


def recent_rows(df: DataFrame, n: int, axis: Axis = DAILY) -> DataFrame:
    newest = Window.partitionBy(*axis.key).orderBy(*[F.desc(c) for c in axis.order])
    return df.withColumn("_back", F.row_number().over(newest)).filter(C("_back") <= n).drop("_back")


def signal_columns(r: Column) -> dict[str, Column]:
    """Buy above 2 %, sell below -2 %, else hold; strength saturates at 5 %."""
    moved = F.least(F.abs(r) / 0.05, F.lit(1.0))
    return {
        "signal": F.when(r > 0.02, "buy").when(r < -0.02, "sell").otherwise("hold"),
        "strength": F.when(F.abs(r) > 0.02, moved).otherwise(0.5 - F.abs(r) / 0.04),
    }


def fallback_forecast(df: DataFrame, horizon: int = 5, axis: Axis = DAILY, price: str = "close", window: int = 20) -> DataFrame:
    """Mean of the last returns times the horizon, with a two-sigma interval and a signal."""
    rets = df.select(*axis.key, *axis.order, price).withColumn("_ret", axis.pct(price))
    order = F.struct(*axis.order)
    known = recent_rows(rets.filter(C("_ret").isNotNull()), window, axis)
    out = known.groupBy(*axis.key).agg(F.max_by(price, order).alias("current_price"), F.avg("_ret").alias("_m"), F.stddev_samp("_ret").alias("_s"))
    r, band = C("_m") * horizon, 2 * C("_s") * math.sqrt(horizon)
    out = out.withColumns({"predicted_return": r, "predicted_price": C("current_price") * (1 + r), "lower": C("current_price") * (1 + r - band), "upper": C("current_price") * (1 + r + band)})
    return out.drop("_m", "_s").withColumns(signal_columns(C("predicted_return")))


def price_from_return(df: DataFrame, price: str = "current_price", ret: str = "predicted_return") -> DataFrame:
    """Predicted price and a five-percent band around it."""
    p = C(price) * (1 + C(ret))
    return df.withColumns({"predicted_price": p, "lower": p * 0.95, "upper": p * 1.05})


def batch_forecast(requested: DataFrame, bars: DataFrame, horizon: int = 5, axis: Axis = DAILY, **kw) -> tuple[DataFrame, DataFrame]:
    """(forecasts, requested symbols without data)."""
    wanted = bars.join(requested, list(axis.key), "left_semi")
    done = fallback_forecast(wanted, horizon, axis, **kw)
    return done, requested.join(done, list(axis.key), "left_anti")


# ------------------------------------------------------------ fitted forecasters


# Plain fitters for a series at hand; tables go through ``smoothing``, which is held against these.
# Every fitter takes windows of equal length, one per row, and returns (forecasts, one-step errors), one row per window.


def _smooth(y: np.ndarray, sp: int, alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray):
    """Additive exponential smoothing for many windows and parameter sets at once; returns final state and errors."""
    windows, n = y.shape
    shape = (windows, len(alpha))
    season = np.zeros((max(sp, 1), *shape))
    if sp > 1:
        mean = y[:, :sp].mean(axis=1)
        level = np.broadcast_to(mean[:, None], shape)
        trend = np.broadcast_to(((y[:, sp : 2 * sp].mean(axis=1) - mean) / sp)[:, None], shape)
        season[:] = (y[:, :sp] - mean[:, None]).T[:, :, None]
        start = 0
    else:
        level, trend, start = np.broadcast_to(y[:, :1], shape), np.broadcast_to(y[:, 1:2] - y[:, :1] if n > 1 else 0.0, shape), 1
    errors = np.empty((n - start, *shape))
    for i in range(start, n):
        s = season[i % sp] if sp > 1 else 0.0
        e = y[:, i, None] - (level + trend + s)
        errors[i - start] = e
        level, trend = level + trend + alpha * e, trend + alpha * beta * e
        if sp > 1:
            season[i % sp] = s + gamma * (1 - alpha) * e
    return level, trend, season, errors


_STEPS = (0.1, 0.3, 0.5, 0.7, 0.9)


def _holt(y: np.ndarray, h: int, sp: int) -> tuple[np.ndarray, np.ndarray]:
    """Additive trend (and season) smoothing; parameters by least squared one-step error over a grid."""
    windows, n = y.shape
    if sp > 1 and n < 2 * sp:
        sp = 1
    grid = np.array(list(itertools.product(_STEPS, (0.01, 0.1, 0.3), (0.1, 0.5) if sp > 1 else (0.0,))))
    level, trend, season, err = _smooth(y, sp, grid[:, 0], grid[:, 1], grid[:, 2])
    best, row = np.argmin((err**2).sum(axis=0), axis=1), np.arange(windows)
    step = np.arange(1, h + 1)
    seasonal = season[(n - 1 + step) % sp][:, row, best].T if sp > 1 else 0.0
    return level[row, best][:, None] + step * trend[row, best][:, None] + seasonal, err[:, row, best].T


def _theta(y: np.ndarray, h: int, sp: int) -> tuple[np.ndarray, np.ndarray]:
    """Theta method: simple smoothing plus half the linear slope."""
    alphas = np.linspace(0.05, 0.95, 19)
    windows, n = y.shape
    level = np.broadcast_to(y[:, :1], (windows, len(alphas)))
    err = np.empty((n, windows, len(alphas)))
    for i in range(n):
        err[i] = y[:, i, None] - level
        level = level + alphas * err[i]
    best, row = np.argmin((err**2).sum(axis=0), axis=1), np.arange(windows)
    t = np.arange(n) - (n - 1) / 2
    slope = (y - y.mean(axis=1, keepdims=True)) @ t / max((t**2).sum(), 1e-12)
    a = alphas[best][:, None]
    drift = 0.5 * slope[:, None] * (np.arange(h) + (1 - (1 - a) ** n) / a)
    return level[row, best][:, None] + drift, err[1:, row, best].T


def _naive(y: np.ndarray, h: int, sp: int) -> tuple[np.ndarray, np.ndarray]:
    """Last value (or last season) repeated."""
    sp = sp if sp > 1 and y.shape[1] >= sp else 1
    return y[:, -sp:][:, np.arange(h) % sp], y[:, sp:] - y[:, :-sp]


def _ensemble(y: np.ndarray, h: int, sp: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [f(y, h, sp) for f in (_holt, _theta, _naive)]
    m = min(e.shape[1] for _, e in parts)
    return np.mean([p for p, _ in parts], axis=0), np.mean([e[:, e.shape[1] - m :] for _, e in parts], axis=0)


MODELS = {"exp_smoothing": _holt, "theta": _theta, "naive": _naive, "ensemble": _ensemble}


def fit_forecast(y: np.ndarray, model: str, h: int, sp: int = 1, log: bool = False, coverage: float = 0.9) -> pd.DataFrame:
    """h-step forecast of one series at hand, with an interval from the one-step errors; tables go through ``forecast``."""
    shift = 0.0
    if log:
        shift = abs(y.min()) + 1e-8 if y.min() <= 0 else 0.0
        y = np.log(y + shift)
    point, err = (part[0] for part in MODELS[model](np.asarray(y, float)[None, :], h, sp))
    sigma = err.std(ddof=1) if len(err) > 1 else 0.0
    band = NormalDist().inv_cdf(0.5 + coverage / 2) * sigma * np.sqrt(np.arange(1, h + 1))
    cols = [point, point - band, point + band]
    if log:
        cols = [np.exp(c) - shift for c in cols]
    return pd.DataFrame({"step": np.arange(1, h + 1, dtype="int32"), "predicted": cols[0], "lower": cols[1], "upper": cols[2]})


def _as_arrays(df: DataFrame, axis: Axis, value: str, gaps: bool = False) -> DataFrame:
    """One row per series: its values in time order (with ``gaps`` the missing ones too), and its last time. For series bounded by the calendar."""
    pair = F.struct(C(axis.ts).alias("t"), C(value).cast("double").alias("v"))
    rows = df.select(*axis.key, C(axis.ts).alias("_t"), (pair if gaps else F.when(C(value).isNotNull(), pair)).alias("_r"))
    return rows.groupBy(*axis.key).agg(F.transform(F.sort_array(F.collect_list("_r")), lambda r: r["v"]).alias("y"), F.max("_t").alias("_last"))


def forecast(
    df: DataFrame,
    models: Sequence[str] = ("exp_smoothing", "theta", "naive"),
    horizon: int = 5,
    axis: Axis = DAILY,
    value: str = "close",
    seasonal_period: int = 1,
    log: bool = False,
    coverage: float = 0.9,
    min_rows: int = 3,
) -> DataFrame:
    """Fit every model to every series and forecast ``horizon`` business days, with an interval from the one-step errors.

    A series is one array in one row; tasks fit many arrays at once (``smoothing``). For series bounded by the calendar:
    a few thousand numbers at most.  ``too_short`` names the series left out.
    """
    keys = list(axis.key)
    series = _as_arrays(df, axis, value).filter(F.size("y") >= max(min_rows, 1))
    series = series.withColumn("_shift", F.lit(0.0))
    if log:
        low = F.array_min("y")
        series = series.withColumn("_shift", F.when(low <= 0, F.abs(low) + 1e-8).otherwise(0.0))
        series = series.withColumn("y", F.transform("y", lambda v: F.ln(v + C("_shift"))))
    fits = smoothing.fitted(series, models, horizon, seasonal_period).withColumn("_days", cal.next_weekdays(C("_last"), horizon))
    fits = fits.select(*keys, "_shift", "_days", F.inline_outer("fits"))
    ahead = F.arrays_zip(C("path").alias("predicted"), C("_days").alias(axis.ts))
    steps = fits.select(*keys, "_shift", "model", "sigma", F.posexplode(ahead).alias("_i", "_at")).select("*", "_at.*").filter(C(axis.ts).isNotNull())
    band = NormalDist().inv_cdf(0.5 + coverage / 2) * C("sigma") * F.sqrt(C("_i") + 1)
    back = (lambda c: F.exp(c) - C("_shift")) if log else (lambda c: c)
    return steps.select(
        *keys, (C("_i") + 1).alias("step"), "model", back(C("predicted")).alias("predicted"), back(C("predicted") - band).alias("lower"),
        back(C("predicted") + band).alias("upper"), axis.ts,
    )


def too_short(df: DataFrame, axis: Axis = DAILY, value: str = "close", min_rows: int = 3) -> DataFrame:
    """Series that get no forecast, with the number of known values and the reason."""
    known = df.groupBy(*axis.key).agg(F.count(value).alias("known"))
    reason = F.concat(C("known").cast("string"), F.lit(f" known values, {min_rows} needed"))
    return known.filter(C("known") < min_rows).withColumn("reason", reason)


def update_forecast(history: DataFrame, fresh: DataFrame, **kw) -> DataFrame:
    """Forecast again after new observations have arrived."""
    return forecast(history.unionByName(fresh), **kw)


def cross_validate(
    df: DataFrame,
    models: Sequence[str] = ("exp_smoothing", "theta", "naive"),
    splits: int = 5,
    test_size: int = 30,
    step: int = 1,
    axis: Axis = DAILY,
    value: str = "close",
    seasonal_period: int = 1,
) -> DataFrame:
    """Sliding-window folds (window n // (splits+1)), metrics per (series, model, fold).

    A series is one array. It is dealt to all tasks in stretches of ``FOLDS`` folds, which overlap by a window and a horizon only,
    and the folds are cut, fitted and scored where their stretch is.  A series with a window under 3 rows, or shorter than
    window and horizon, has no folds.
    """
    keys = list(axis.key)
    n = F.size("y")
    series = _as_arrays(df, axis, value, gaps=True).withColumn("_w", F.floor(n / (splits + 1)).cast("int")).filter((C("_w") >= 3) & (n >= C("_w") + test_size))
    starts = F.sequence(F.lit(0), ((n - C("_w") - test_size) / step).cast("int"), F.lit(FOLDS))
    cut = series.select(*keys, "y", "_w", F.explode(starts).alias("_first"))
    stretch = F.slice("y", C("_first") * step + 1, C("_w") + test_size + (FOLDS - 1) * step)
    cut = cut.select(*keys, "_w", C("_first").cast("long").alias("_first"), stretch.alias("y"))
    # much work per byte: keep all partitions
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return smoothing.fold_metrics(cut.repartition(tasks, *keys, "_first"), models, test_size, step, seasonal_period)


def select_best(df: DataFrame, horizon: int = 5, axis: Axis = DAILY, score: str = "smape", cv: DataFrame | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """(forecasts of each series' best model, ranked scores).  The score is the mean over folds."""
    models = kw.pop("models", ("exp_smoothing", "theta", "naive"))
    value = kw.pop("value", "close")
    folds = cv if cv is not None else cross_validate(df, models, axis=axis, value=value, **kw)
    means = folds.groupBy(*axis.key, "model").agg(F.avg(score).alias(score), F.stddev_pop(score).alias(f"{score}_std"))
    ranked = rank_models(means, axis.key, score)
    best = ranked.filter(C("rank") == 1).select(*axis.key, "model")
    return forecast(df, models, horizon, axis, value).join(best, [*axis.key, "model"], "left_semi"), ranked
