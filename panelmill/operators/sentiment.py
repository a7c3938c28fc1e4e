"""Daily sentiment, sentiment features and their alignment with market rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import DAILY, Axis, Scan, Wave, apply_waves, delayed, exact_quantiles, number_rows, per_key, position, stacked
from ..functions.exprs import div, elapsed_hours, flag, full, nz, total
from ..functions.recursive import ewm
from ..functions.rolling import rolling_corr, rolling_percent_rank
from . import calendar as cal
from .clean import forward_fill, weekday_effects

C = F.col


# ------------------------------------------------------------ events to days


def daily_sentiment(
    df: DataFrame,
    key: Sequence[str] = ("symbol",),
    ts: str = "ts",
    tie: Sequence[str] = (),
    score: str = "sentiment_score",
    confidence: str | None = "confidence",
    source: str | None = "source",
    sources: Sequence[str] | None = None,
    recency_decay: float = 0.1,
    weight_by_confidence: bool = True,
    weight_by_recency: bool = True,
    intraday: bool = True,
    sorted_median: bool = False,
    null_to_zero: bool = True,
) -> DataFrame:
    """Scored events to one row per (key, day).

    Everything but the intraday rank features is a plain aggregate with
    map-side combine, so a day of any size is folded before the shuffle; the
    rank features use a distributed row number.  The median keeps one counter
    per distinct score; ``sorted_median`` sorts instead, for continuous scores.
    """
    s, day = C(score), C(ts).cast("date")
    keys = [*key, "date"]
    rows = df.withColumn("date", day).filter(day.isNotNull())
    has_conf = confidence is not None and confidence in df.columns
    if intraday:
        rows = number_rows(rows, Axis(tuple(keys), ts, tuple(tie)), "_rn", count="_n")

    aggs: list[Column] = [
        F.avg(s).alias("sentiment_mean"),
        F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("sentiment_std"),
        F.count(F.lit(1)).alias("sentiment_count"),
        F.count(F.lit(1)).alias("news_volume"),
        F.min(s).alias("sentiment_min"),
        F.max(s).alias("sentiment_max"),
        (F.max(s) - F.min(s)).alias("sentiment_range"),
        F.count_if(s > 0.1).alias("positive_sentiment_count"),
        F.count_if(s < -0.1).alias("negative_sentiment_count"),
        (F.count(F.lit(1)) - F.count_if(s > 0.1) - F.count_if(s < -0.1)).alias("neutral_sentiment_count"),
        F.avg(F.abs(s)).alias("sentiment_intensity"),
        (F.count_if(F.abs(s) > 0.5) / F.count(F.lit(1))).alias("sentiment_extremeness"),
    ]
    if not sorted_median:
        aggs.append(F.percentile(s, F.lit(0.5)).alias("sentiment_median"))
    scratch: list[str] = []
    if has_conf:
        c = C(confidence)
        if weight_by_confidence:
            # exp(-d * (24 - (h - h0))) = exp(d * h) * exp(-d * (24 + h0)); the second factor is one per day
            hours = elapsed_hours(ts, day)
            w = c * F.exp(hours * recency_decay) if weight_by_recency else c
            scale = F.exp(-(F.min(hours) + 24) * recency_decay) if weight_by_recency else F.lit(1.0)
            sw, sws = F.sum(w), F.sum(w * s)
            aggs += [
                F.when(sw > 0, F.try_divide(sws, sw)).otherwise(F.avg(s)).alias("sentiment_weighted_mean"),
                F.when(sw > 0, F.avg(w) * scale).otherwise(F.lit(0.5)).alias("avg_confidence"),
            ]
        else:
            aggs += [F.avg(s).alias("sentiment_weighted_mean"), F.avg(c).alias("avg_confidence")]
    if intraday:
        half, r, n = F.floor(C("_n") / 2), C("_rn"), C("_n")
        x = r.cast("double")
        aggs += [
            F.avg(F.when(r < half, s)).alias("_early"),
            F.avg(F.when(r >= half, s)).alias("_late"),
            F.try_divide(F.covar_samp(s, x), F.stddev_samp(s) * F.stddev_samp(x)).alias("_corr"),
            (F.min(s) == F.max(s)).alias("_flat"),
            F.max(n).alias("_days_n"),
        ]
        scratch = ["_early", "_late", "_corr", "_flat", "_days_n"]
    out = rows.groupBy(*keys).agg(*aggs)
    for side in ("positive", "negative", "neutral"):
        out = out.withColumn(f"{side}_sentiment_pct", C(f"{side}_sentiment_count") / C("sentiment_count"))
    if intraday:
        many = C("_days_n") > 1
        out = out.withColumns(
            {
                "intraday_sentiment_trend": F.when(many, C("_late") - C("_early")),
                "intraday_momentum": F.when((C("_days_n") > 2) & ~C("_flat"), C("_corr")),
            }
        ).drop(*scratch)
    if sorted_median:
        med = exact_quantiles(rows, keys, score, {"sentiment_median": 0.5})
        out = out.join(med, keys, "left")
    if source is not None and source in df.columns:
        out = out.join(source_breakdown(rows, keys, score, source, sources), keys, "left")
    if null_to_zero:
        out = out.withColumns({c: F.coalesce(C(c), F.lit(0)) for c, t in out.dtypes if c not in keys and t in ("double", "bigint", "int")})
    return out


def source_breakdown(rows: DataFrame, keys: Sequence[str], score: str, source: str, sources: Sequence[str] | None = None) -> DataFrame:
    """Source diversity, share of the commonest source among all rows, and mean/count per source.

    ``sources=None`` gives columns to every source present (one distinct query, sources are few); a list gives them to those only.

    A missing source is none: it adds to the rows only; without any named source the share is null.

    Two aggregation levels: the first leaves one row per source and day.
    """
    if sources is None:
        sources = sorted(r[0] for r in rows.select(C(source).cast("string")).filter(C(source).isNotNull()).distinct().collect())
    each = rows.groupBy(*keys, source).agg(F.count(F.lit(1)).alias("_k"), F.avg(score).alias("_m"))
    aggs = [F.count(source).alias("source_diversity"), (F.max(F.when(C(source).isNotNull(), C("_k"))) / F.sum("_k")).alias("dominant_source_pct")]
    for name in sources:
        hit = C(source) == name
        aggs += [
            F.max(F.when(hit, C("_m"))).alias(f"sentiment_{name}_mean"),
            F.coalesce(F.max(F.when(hit, C("_k"))), F.lit(0)).alias(f"sentiment_{name}_count"),
        ]
    return each.groupBy(*keys).agg(*aggs)


# ------------------------------------------------------------ momentum features


def _run_length(axis: Axis, changed: str, out: str) -> tuple[Wave, Wave]:
    """Rows since the last ``changed`` flag, counting from 1."""
    return (
        {f"_t_{out}_at": Scan("last", F.when(C(changed), C("_t_pos")))},
        {out: (C("_t_pos") - C(f"_t_{out}_at") + 1).cast("bigint")},
    )


def sentiment_momentum(axis: Axis = DAILY, value: str = "sentiment_mean", windows: Sequence[int] = (3, 7, 14, 30), acceleration: bool = True, volatility: bool = True) -> list[Wave]:
    x = C(value)
    families: list[list[Wave]] = [[{"_t_pos": position(axis)}]]
    for n in windows:
        w, past = axis.last(n), axis.lag(value, n)
        ma, sd, mom = C(f"sentiment_ma_{n}d"), C(f"_t_sd_{n}"), C(f"sentiment_momentum_{n}d")
        lo, hi = F.min(x).over(w), F.max(x).over(w)
        w0: Wave = {
            f"sentiment_momentum_{n}d": x - past,
            f"sentiment_roc_{n}d": div(x - past, nz(F.abs(past), 0.001)) * 100,
            f"sentiment_ma_{n}d": F.avg(x).over(w),
            f"_t_sd_{n}": F.stddev_samp(x).over(w),
            f"sentiment_position_{n}d": div(x - lo, nz(hi - lo, 1.0)),
        }
        w1: Wave = {
            f"sentiment_ma_momentum_{n}d": x - ma,
            f"sentiment_trend_{n}d": F.when(F.count(x).over(w) >= 3, F.coalesce(rolling_corr(x, C("_t_pos").cast("double"), w, 3), F.lit(0.0))),
            f"sentiment_regime_{n}d": F.when(x > ma + 0.5 * sd, 1).when(x < ma - 0.5 * sd, -1).otherwise(0),
            f"_t_turn_{n}": F.coalesce(F.signum(mom) != axis.lag(F.signum(mom)), F.lit(True)),
        }
        if volatility:
            w1[f"sentiment_volatility_{n}d"] = sd
            w1[f"sentiment_volatility_norm_{n}d"] = div(sd, nz(F.abs(ma), 0.001))
        if acceleration:
            w1[f"sentiment_momentum_acceleration_{n}d"] = axis.diff(mom)
        families.append([w0, w1, *_run_length(axis, f"_t_turn_{n}", f"sentiment_momentum_persistence_{n}d")])
        recursive = ewm(f"sentiment_ema_{n}d", value, axis, n)
        families.append([*recursive, {f"sentiment_ema_momentum_{n}d": x - C(f"sentiment_ema_{n}d")}])
    if acceleration:
        families.append([{"sentiment_acceleration": x - 2 * axis.lag(value) + axis.lag(value, 2)}])
    if len(windows) >= 2:
        a, b = sorted(windows)[:2]
        fast, slow = C(f"sentiment_ma_{a}d"), C(f"sentiment_ma_{b}d")
        families.append(
            delayed(
                [
                    {
                        "sentiment_momentum_fast_vs_slow": C(f"sentiment_momentum_{a}d") - C(f"sentiment_momentum_{b}d"),
                        "sentiment_ma_bullish_cross": flag((fast > slow) & (axis.lag(fast) <= axis.lag(slow))),
                        "sentiment_ma_bearish_cross": flag((fast < slow) & (axis.lag(fast) >= axis.lag(slow))),
                    }
                ],
                1,
            )
        )
    return stacked(*families)


# ------------------------------------------------------------ news volume features


def _beyond(v: Column, axis: Axis, n: int) -> tuple[Callable[[int], Column], Callable[[int], Column]]:
    """Whether ``v`` lies more than k deviations above (or below) its mean over the last n rows, exactly for whole numbers.

    Volumes are counts, so a row may lie just k deviations off, which a rounded deviation puts on either side. With m rows, sum s
    and sum of squares q the question is (m v - s)^2 (m - 1) > k^2 m (m q - s^2), all of it whole.
    """
    x, w = v.cast("double"), axis.last(n)
    m, s, q = F.count(x).over(w), F.sum(x).over(w), F.sum(x * x).over(w)
    off, spread = m * x - s, m * (m * q - s * s)
    far = lambda k: off * off * (m - 1) > k * k * spread
    return lambda k: (off > 0) & far(k), lambda k: (off < 0) & far(k)


def news_volume_features(
    axis: Axis = DAILY,
    volume: str = "news_volume",
    attention: Sequence[str] = ("sentiment_count", "source_diversity"),
    baselines: Sequence[int] = (7, 30, 90),
    surprise: bool = True,
) -> list[Wave]:
    v = C(volume)
    w0: Wave = {"_t_pos": position(axis)}
    w1: Wave = {}
    for n in sorted({*baselines, 7, 14, 30}):
        w0[f"{'' if n in baselines else '_t_'}news_volume_ma_{n}d"] = F.avg(v).over(axis.last(n))
    ma = lambda n: C(f"{'' if n in baselines else '_t_'}news_volume_ma_{n}d")
    for n in baselines:
        w0[f"news_volume_percentile_{n}d"] = rolling_percent_rank(v, axis, n)
        w1[f"news_volume_ratio_{n}d"] = div(v, nz(ma(n), 1.0))
        w1[f"news_volume_above_avg_{n}d"] = flag(v > ma(n))
    for k in (1, 3, 7):
        past = axis.lag(v, k)
        w0[f"news_volume_momentum_{k}d"] = v - past
        w0[f"news_volume_roc_{k}d"] = div(v - past, nz(past, 1)) * 100
    for n in (7, 14, 30):
        w0[f"news_volume_volatility_{n}d"] = F.stddev_samp(v).over(axis.last(n))
        w1[f"news_volume_cv_{n}d"] = div(f"news_volume_volatility_{n}d", nz(ma(n), 1.0))
    above, below = _beyond(v, axis, baselines[1])
    w1["news_volume_spike"] = flag(above(2))
    w1["news_volume_major_spike"] = flag(above(3))
    w1["news_volume_dry_spell"] = flag(below(1))
    w1["zero_news_day"] = flag(v == 0)
    w2: Wave = {}
    runs: list[list[Wave]] = []
    for src, out in (("news_volume_spike", "consecutive_high_volume"), ("news_volume_dry_spell", "consecutive_low_volume")):
        w2[f"_t_{out}_new"] = F.coalesce(C(src) != axis.lag(src), F.lit(True))
        at, length = _run_length(axis, f"_t_{out}_new", f"_t_{out}")
        runs.append(delayed([at, length, {out: F.when(C(src) == 1, C(f"_t_{out}")).otherwise(F.lit(0))}], 3))
    for a in attention:
        w0[f"{a}_per_volume"] = div(a, nz(v, 1))
        for k in (3, 7):
            w0[f"{a}_momentum_{k}d"] = axis.diff(a, k)
        for n in (7, 14):
            w0[f"{a}_concentration_{n}d"] = div(a, F.avg(a).over(axis.last(n)))
    if surprise:
        n = baselines[0]
        w0["_t_surprise_sd"] = F.stddev_samp(v).over(axis.last(n))
        w1["news_surprise_score"] = div(v - ma(n), nz("_t_surprise_sd", 1.0))
        above, below = _beyond(v, axis, n)
        w1["positive_news_surprise"] = flag(above(2))
        w1["negative_news_surprise"] = flag(below(1))
        w0["cumulative_attention_7d"] = F.sum(v).over(axis.last(7))
        w0["cumulative_attention_30d"] = F.sum(v).over(axis.last(30))
        w0["_t_recent"] = F.collect_list(v.cast("double")).over(axis.last(7))
        # a frame shorter than a week takes the smallest weights first
        weighted = F.zip_with("_t_recent", F.slice(F.array(*[F.lit(math.exp(-0.1 * (6 - i))) for i in range(7)]), F.lit(1), F.size("_t_recent")), lambda a, b: F.struct((a * b).alias("x"), b.alias("w")))
        fold = lambda f: F.aggregate(weighted, F.lit(0.0), lambda acc, e: acc + e[f])
        w1["attention_decay_score"] = div(fold("x"), fold("w"))
    w0["_t_median"] = F.percentile(v, F.lit(0.5)).over(axis.last(90))
    w1["high_attention_regime"] = flag(v > C("_t_median") * 1.5)
    w1["low_attention_regime"] = flag(v < C("_t_median") * 0.5)
    return stacked([w0, w1, w2], *runs)


def with_news_volume(df: DataFrame, volume: str = "news_volume") -> DataFrame:
    """Make sure a volume column exists and holds no gaps."""
    if volume not in df.columns:
        df = df.withColumn(volume, C("sentiment_count") if "sentiment_count" in df.columns else F.lit(1))
    return df.withColumn(volume, F.coalesce(C(volume), F.lit(0)))


def sentiment_features(
    df: DataFrame,
    axis: Axis = DAILY,
    value: str = "sentiment_mean",
    volume: str = "news_volume",
    windows: Sequence[int] = (3, 7, 14, 30),
    baselines: Sequence[int] = (7, 30, 90),
    momentum: bool = True,
    volume_indicators: bool = True,
) -> DataFrame:
    """Momentum, news volume, their interactions and a per-row completeness score."""
    families: list[list[Wave]] = []
    if momentum:
        families.append(sentiment_momentum(axis, value, windows))
    if volume_indicators:
        df = with_news_volume(df, volume)
        attention = [c for c in ("sentiment_count", "source_diversity") if c in df.columns]
        families.append(news_volume_features(axis, volume, attention, baselines))
    v, x = C(volume), C(value)
    if volume in df.columns:
        df = per_key(df, axis, {"_t_all_median": F.percentile(v, F.lit(0.5))})
        families.append(
            [
                {
                    "sentiment_volume_weighted": x * F.log1p(v),
                    "sentiment_intensity_high_volume": F.when(v > C("_t_all_median"), F.abs(x)).otherwise(0.0),
                    "sentiment_volume_adjusted": x * rolling_percent_rank(v, axis, 30),
                }
            ]
        )
    if families:
        df = apply_waves(df, axis, *families)
    if volume_indicators:
        df = weekday_effects(df, axis.ts)
    named = [c for c in df.columns if "sentiment" in c and c != value]
    filled = total([C(c).isNotNull().cast("int") for c in named])
    return df.withColumns({"sentiment_feature_count": F.lit(len(named)), "sentiment_data_quality": filled / len(named)})


def smoothed_daily(df: DataFrame, value: str, axis: Axis = DAILY, out: str = "smoothed") -> DataFrame:
    """Centred seven-row mean, only where all seven rows exist."""
    w = axis.by_time().rowsBetween(-3, 3)
    return df.withColumn(out, F.when(F.count(value).over(w) == 7, F.avg(value).over(w)))


# ------------------------------------------------------------ sentiment and market


def sentiment_market_alignment(sentiment: DataFrame, market: DataFrame, axis: Axis = DAILY, value: str = "sentiment_mean", price: str = "close", windows: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Rolling correlation, lead/lag correlation and directional agreement with returns."""
    on = [*axis.key, axis.ts]
    df = sentiment.select(*on, value).join(market.select(*on, price), on)
    s, r = C(value), C("returns")
    w1: Wave = {"_t_same": (F.coalesce(F.signum(s) == F.signum(r), F.lit(False))).cast("double")}
    for k in (1, 2, 3):
        w1[f"_t_next_{k}"] = axis.lead("returns", k)
        w1[f"_t_past_{k}"] = axis.lag("returns", k)
    w2: Wave = {}
    for n in windows:
        w = axis.last(n)
        w2[f"sentiment_return_corr_{n}d"] = rolling_corr(s, r, w, n)
        w2[f"sentiment_direction_agreement_{n}d"] = full(n, "_t_same", w, F.avg("_t_same").over(w))
    for k in (1, 2, 3):
        w2[f"sentiment_lead_corr_{k}d"] = rolling_corr(s, C(f"_t_next_{k}"), axis.last(20), 20)
        w2[f"sentiment_lag_corr_{k}d"] = rolling_corr(s, C(f"_t_past_{k}"), axis.last(20), 20)
    return apply_waves(df, axis, [{"returns": axis.pct(price)}, w1, w2])


def bucket_sentiment(df: DataFrame, method: str = "mean", unit: str = "day", axis: Axis = DAILY, score: str = "sentiment_score", confidence: str = "confidence", half_life_days: float = 0.8) -> DataFrame:
    """Tumbling buckets of scored events: 'mean', 'weighted_mean', 'ewm' or 'last'; empty buckets are missing."""
    s = C(score)
    if method == "weighted_mean" and confidence in df.columns:
        c = C(confidence)
        aggs = [F.try_divide(F.sum(c * s), F.sum(c)).alias("sentiment_score"), F.count(F.lit(1)).alias("sentiment_count"), F.avg(c).alias("avg_confidence")]
    elif method in ("mean", "weighted_mean"):
        aggs = [F.avg(s).alias("sentiment_score")]
    elif method == "ewm":
        # weights relative to the newest item; the common factor cancels, so time of day is enough
        hours = elapsed_hours(axis.ts, C(axis.ts).cast("date"))
        w = F.pow(F.lit(2.0), hours / (24 * half_life_days))
        aggs = [F.try_divide(F.sum(w * s), F.sum(w)).alias("sentiment_score")]
    elif method == "last":
        aggs = [F.max_by(s, F.struct(*axis.order)).alias("sentiment_score")]
    else:
        raise ValueError(f"unknown aggregation method: {method}")
    return cal.resample(df, aggs, unit, axis)


def align_sentiment(market: DataFrame, events: DataFrame, method: str = "mean", unit: str = "day", axis: Axis = DAILY, tie: Sequence[str] = (), half_life_days: float = 0.8, carry: int = 7, suffix: str = "_sentiment") -> DataFrame:
    """Market rows with bucketed sentiment carried at most ``carry`` buckets, its age and its trend."""
    buckets = bucket_sentiment(events, method, unit, Axis(axis.key, axis.ts, tuple(tie)), half_life_days=half_life_days)
    values = [c for c in buckets.columns if c not in (*axis.key, axis.ts)]
    buckets = forward_fill(buckets, values, axis, limit=carry)
    clash = {c.lower() for c in market.columns} & {c.lower() for c in values}
    buckets = buckets.select(*axis.key, axis.ts, *[C(c).alias(c + suffix) if c.lower() in clash else C(c) for c in values])
    out = market.join(buckets, [*axis.key, axis.ts], "left")
    s = C("sentiment_score")
    micros = F.unix_micros(C(axis.ts).cast("timestamp"))
    w0: Wave = {
        "_t_seen": Scan("last", F.when(s.isNotNull(), micros)),
        "sentiment_ma_3d": full(3, s, axis.last(3), F.avg(s).over(axis.last(3))),
        "sentiment_ma_7d": full(7, s, axis.last(7), F.avg(s).over(axis.last(7))),
        "sentiment_volatility": full(7, s, axis.last(7), F.stddev_samp(s).over(axis.last(7))),
    }
    w1: Wave = {
        "sentiment_age_hours": F.coalesce((micros - C("_t_seen")) / 3.6e9, F.lit(0.0)),
        "sentiment_momentum": s - C("sentiment_ma_7d"),
    }
    return apply_waves(out, axis, [w0, w1])


def sentiment_coverage(df: DataFrame, value: str = "sentiment_score") -> DataFrame:
    """Share of rows with a score, in percent."""
    return df.agg((F.count(value) / F.count(F.lit(1)) * 100).alias("coverage_pct"))


def model_sentiment_fallback(df: DataFrame, score: str = "sentiment_score", count: str = "news_volume") -> DataFrame:
    """Stand-in columns when no model-scored sentiment exists."""
    have = count in df.columns
    return df.withColumns(
        {
            "llm_sentiment_mean": C(score) * 0.9,
            "llm_sentiment_std": F.abs(score) * 0.15,
            "llm_sentiment_count": C(count) if have else F.lit(1),
        }
    )


def sentiment_summary(df: DataFrame, key: Sequence[str] = ("symbol",), value: str = "sentiment_mean", articles: str = "news_volume") -> DataFrame:
    return df.groupBy(*key).agg(
        F.avg(value).alias("average_sentiment"),
        F.stddev_samp(value).alias("sentiment_volatility"),
        F.sum(articles).alias("total_articles"),
        F.count(F.lit(1)).alias("days"),
    )


def score_histogram(df: DataFrame, value: str = "sentiment_score", bins: int = 20, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """Counts per equal-width bin; the upper edge belongs to the last bin."""
    b = F.least(F.width_bucket(C(value), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    return df.filter(C(value).between(lo, hi)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def combine_daily(existing: DataFrame, fresh: DataFrame, on: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Fill gaps of an existing daily table from a fresh aggregation of the raw events."""
    from .joins import combine_first

    return combine_first(existing, fresh, on)


def momentum_table(df: DataFrame, axis: Axis = DAILY, **kw) -> DataFrame:
    return apply_waves(df, axis, sentiment_momentum(axis, **kw))


def news_volume_table(df: DataFrame, axis: Axis = DAILY, volume: str = "news_volume", **kw) -> DataFrame:
    df = with_news_volume(df, volume)
    attention = [c for c in kw.pop("attention", ("sentiment_count", "source_diversity")) if c in df.columns]
    return weekday_effects(apply_waves(df, axis, news_volume_features(axis, volume, attention, **kw)), axis.ts)


