"""Sentiment aggregation, feature and alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..operators import sentiment as sen
from . import fixtures as fx
from .catalog import Shape, query
from .sqlkit import ema_chain, fl, full, wins

C = F.col
NEWS, UBARS = fx.NEWS_SQL, fx.USER_BARS_SQL
_EXACT_NEWS = "en AS (SELECT * REPLACE (CAST(round(sentiment_score * 100) AS DOUBLE) AS sentiment_score, CAST(round(confidence * 100) AS DOUBLE) AS confidence) FROM news)"
_POL = ("positive", "negative", "neutral")

_DAILY = f"""{NEWS},
nd AS (SELECT *, CAST(ts AS DATE) AS date, row_number() OVER o AS rn, count(*) OVER (PARTITION BY symbol, CAST(ts AS DATE)) AS n,
  min(ts) OVER (PARTITION BY symbol, CAST(ts AS DATE)) AS t0 FROM news WINDOW o AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, event_id)),
nw AS (SELECT *, confidence * exp(-0.1 * (24 - date_diff('microsecond', t0, ts) / 3600000000.0)) AS wt FROM nd),
sd AS (SELECT symbol, date, source, count(*) AS k, avg(sentiment_score) AS m FROM nd GROUP BY 1, 2, 3),
sx AS (SELECT symbol, date, count(*) AS source_diversity, max(k) / sum(k) AS dominant_source_pct,
  {", ".join(f"coalesce(max(m) FILTER (WHERE source = '{x}'), 0) AS sentiment_{x}_mean, CAST(coalesce(max(k) FILTER (WHERE source = '{x}'), 0) AS BIGINT) AS sentiment_{x}_count" for x in fx.SOURCES)}
  FROM sd GROUP BY 1, 2),
ag AS (SELECT symbol, date, avg(sentiment_score) AS sentiment_mean, quantile_cont(sentiment_score, 0.5) AS sentiment_median,
  coalesce(stddev_samp(sentiment_score), 0) AS sentiment_std, count(*) AS sentiment_count, count(*) AS news_volume,
  min(sentiment_score) AS sentiment_min, max(sentiment_score) AS sentiment_max, max(sentiment_score) - min(sentiment_score) AS sentiment_range,
  count(*) FILTER (WHERE sentiment_score > 0.1) AS positive_sentiment_count, count(*) FILTER (WHERE sentiment_score < -0.1) AS negative_sentiment_count,
  count(*) FILTER (WHERE sentiment_score BETWEEN -0.1 AND 0.1) AS neutral_sentiment_count, avg(abs(sentiment_score)) AS sentiment_intensity,
  avg(CASE WHEN abs(sentiment_score) > 0.5 THEN 1.0 ELSE 0.0 END) AS sentiment_extremeness,
  CASE WHEN sum(wt) > 0 THEN sum(wt * sentiment_score) / sum(wt) ELSE avg(sentiment_score) END AS sentiment_weighted_mean,
  CASE WHEN sum(wt) > 0 THEN avg(wt) ELSE 0.5 END AS avg_confidence,
  coalesce(avg(sentiment_score) FILTER (WHERE rn > n // 2) - avg(sentiment_score) FILTER (WHERE rn <= n // 2), 0) AS intraday_sentiment_trend,
  CASE WHEN count(*) > 2 AND min(sentiment_score) < max(sentiment_score) THEN corr(sentiment_score, rn) ELSE 0 END AS intraday_momentum
  FROM nw GROUP BY 1, 2),
daily AS (SELECT a.*, {", ".join(f"{p}_sentiment_count / sentiment_count AS {p}_sentiment_pct" for p in _POL)}, s.* EXCLUDE (symbol, date)
  FROM ag a JOIN sx s ON a.symbol = s.symbol AND a.date = s.date)"""


def _daily(spark, sf):
    return sen.daily_sentiment(fx.news(spark, sf), tie=["event_id"])


@query(
    "daily_sentiment",
    Shape(
        ["symbol"], ["date"], ["sentiment_count", "news_volume", *[f"{p}_sentiment_count" for p in _POL]],
        [
            "sentiment_mean", "sentiment_median", "sentiment_std", "sentiment_min", "sentiment_max", "sentiment_range", "sentiment_intensity",
            "sentiment_extremeness", "intraday_sentiment_trend", "intraday_momentum", *[f"{p}_sentiment_pct" for p in _POL],
        ],
    ),
    f"{_DAILY}, res AS (SELECT * FROM daily)",
)
def daily_sentiment(spark, sf):
    return _daily(spark, sf)


@query(
    "weighted_sentiment",
    Shape(["symbol"], ["date"], [], ["sentiment_weighted_mean", "avg_confidence"]),
    f"{_DAILY}, res AS (SELECT * FROM daily)",
)
def weighted_sentiment(spark, sf):
    return sen.daily_sentiment(fx.news(spark, sf), source=None, intraday=False)


@query(
    "sentiment_by_source",
    Shape(
        ["symbol"], ["date"], ["source_diversity", *[f"sentiment_{x}_count" for x in fx.SOURCES]],
        ["dominant_source_pct", *[f"sentiment_{x}_mean" for x in fx.SOURCES]],
    ),
    f"{_DAILY}, res AS (SELECT * FROM daily)",
)
def sentiment_by_source(spark, sf):
    return sen.daily_sentiment(fx.news(spark, sf), sources=fx.SOURCES, intraday=False)


@query(
    "heavy_day_sentiment",
    Shape(["source"], ["date"], ["sentiment_count"], ["sentiment_mean", "sentiment_median", "intraday_sentiment_trend", "intraday_momentum"]),
    f"""{NEWS}, {_EXACT_NEWS},
nd AS (SELECT *, CAST(ts AS DATE) AS date, row_number() OVER (PARTITION BY source, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn,
  count(*) OVER (PARTITION BY source, CAST(ts AS DATE)) AS n FROM en),
res AS (SELECT source, date, count(*) AS sentiment_count, avg(sentiment_score) AS sentiment_mean, quantile_cont(sentiment_score, 0.5) AS sentiment_median,
  coalesce(avg(sentiment_score) FILTER (WHERE rn > n // 2) - avg(sentiment_score) FILTER (WHERE rn <= n // 2), 0) AS intraday_sentiment_trend,
  CASE WHEN count(*) > 2 AND min(sentiment_score) < max(sentiment_score) THEN corr(sentiment_score, rn) ELSE 0 END AS intraday_momentum FROM nd GROUP BY 1, 2)""",
)
def heavy_day_sentiment(spark, sf):
    """Five sources share all events: ranks and medians come from distributed sorts."""
    return sen.daily_sentiment(_exact_news(spark, sf), key=["source"], tie=["event_id"], source=None, confidence=None, sorted_median=True)


# ------------------------------------------------------------ features over days
_BASE = f"""{NEWS},
b0 AS (SELECT symbol, CAST(ts AS DATE) AS ts, avg(CAST(round(sentiment_score * 100) AS DOUBLE)) AS sentiment_mean, count(*) AS news_volume,
  count(*) AS sentiment_count, count(DISTINCT source) AS source_diversity FROM news GROUP BY 1, 2)"""


def _days(spark, sf):
    """Daily table with exact (scaled) means so both engines agree on every digit."""
    n = fx.news(spark, sf).withColumn("sentiment_score", F.round(C("sentiment_score") * 100))
    return sen.daily_sentiment(n, sources=(), intraday=False).withColumnRenamed("date", "ts")


_W = (3, 7, 14, 30)


def _trend(n: int) -> str:
    return f"""CASE WHEN count(*) OVER w{n} >= 3 THEN CASE WHEN min(sentiment_mean) OVER w{n} < max(sentiment_mean) OVER w{n}
      THEN corr(sentiment_mean, rn) OVER w{n} ELSE 0 END END AS sentiment_trend_{n}d"""


_momentum_sql = f"""{_BASE},
{ema_chain("b0", {f"sentiment_ema_{n}d": ("sentiment_mean", n) for n in _W}, "b1")},
b2 AS (SELECT *, row_number() OVER w AS rn, {", ".join(f"sentiment_mean - lag(sentiment_mean, {n}) OVER w AS sentiment_momentum_{n}d, avg(sentiment_mean) OVER w{n} AS sentiment_ma_{n}d, stddev_samp(sentiment_mean) OVER w{n} AS sd{n}, (sentiment_mean - lag(sentiment_mean, {n}) OVER w) / (CASE WHEN lag(sentiment_mean, {n}) OVER w = 0 THEN 0.001 ELSE abs(lag(sentiment_mean, {n}) OVER w) END) * 100 AS sentiment_roc_{n}d, (sentiment_mean - min(sentiment_mean) OVER w{n}) / (CASE WHEN max(sentiment_mean) OVER w{n} = min(sentiment_mean) OVER w{n} THEN 1 ELSE max(sentiment_mean) OVER w{n} - min(sentiment_mean) OVER w{n} END) AS sentiment_position_{n}d" for n in _W)} FROM b1 {wins(*_W)}),
b3 AS (SELECT *, {", ".join(_trend(n) for n in _W)},
  {", ".join(f"CASE WHEN sign(sentiment_momentum_{n}d) IS DISTINCT FROM lag(sign(sentiment_momentum_{n}d)) OVER w OR sentiment_momentum_{n}d IS NULL THEN 1 ELSE 0 END AS turn{n}" for n in _W)} FROM b2 {wins(*_W)}),
b4 AS (SELECT *, {", ".join(f"sum(turn{n}) OVER cum AS grp{n}" for n in _W)} FROM b3 {wins()}),
res AS (SELECT *, sentiment_mean - 2 * lag(sentiment_mean) OVER w + lag(sentiment_mean, 2) OVER w AS sentiment_acceleration,
  sentiment_momentum_3d - sentiment_momentum_7d AS sentiment_momentum_fast_vs_slow,
  {fl("sentiment_ma_3d > sentiment_ma_7d AND lag(sentiment_ma_3d) OVER w <= lag(sentiment_ma_7d) OVER w")} AS sentiment_ma_bullish_cross,
  {fl("sentiment_ma_3d < sentiment_ma_7d AND lag(sentiment_ma_3d) OVER w >= lag(sentiment_ma_7d) OVER w")} AS sentiment_ma_bearish_cross,
  {", ".join(f"sentiment_mean - sentiment_ma_{n}d AS sentiment_ma_momentum_{n}d, sentiment_mean - sentiment_ema_{n}d AS sentiment_ema_momentum_{n}d, sd{n} AS sentiment_volatility_{n}d, sd{n} / (CASE WHEN sentiment_ma_{n}d = 0 THEN 0.001 ELSE abs(sentiment_ma_{n}d) END) AS sentiment_volatility_norm_{n}d, CASE WHEN sentiment_mean > sentiment_ma_{n}d + 0.5 * sd{n} THEN 1 WHEN sentiment_mean < sentiment_ma_{n}d - 0.5 * sd{n} THEN -1 ELSE 0 END AS sentiment_regime_{n}d, sentiment_momentum_{n}d - lag(sentiment_momentum_{n}d) OVER w AS sentiment_momentum_acceleration_{n}d, row_number() OVER (PARTITION BY symbol, grp{n} ORDER BY ts) AS sentiment_momentum_persistence_{n}d" for n in _W)}
  FROM b4 {wins()})"""
_m = lambda *stems: [f"sentiment_{s}_{n}d" for s in stems for n in _W]


_MOMENTUM = (
    [*_m("regime", "momentum_persistence"), "sentiment_ma_bullish_cross", "sentiment_ma_bearish_cross"],
    _m("trend", "position", "ema"),
    [
        *_m("momentum", "ma", "ma_momentum", "ema_momentum", "volatility", "volatility_norm", "momentum_acceleration", "roc"),
        "sentiment_acceleration", "sentiment_momentum_fast_vs_slow",
    ],
)


@query("sentiment_momentum", Shape(["symbol"], ["ts"], *_MOMENTUM), _momentum_sql)
def sentiment_momentum(spark, sf):
    return sen.momentum_table(_days(spark, sf))


_att = ("sentiment_count", "source_diversity")
_decay = "[" + ", ".join(f"exp(-0.1 * {6 - i})" for i in range(7)) + "]"
_rank = lambda n: f"""(len(list_filter(l{n}, lambda q: q < news_volume)) + (len(list_filter(l{n}, lambda q: q = news_volume)) + 1) / 2.0) / len(l{n})"""
_volume_sql = f"""{_BASE},
v0 AS (SELECT *, {", ".join(f"avg(news_volume) OVER w{n} AS news_volume_ma_{n}d, list(news_volume) OVER w{n} AS l{n}" for n in (7, 14, 30, 90))},
  {", ".join(f"coalesce(stddev_samp(news_volume) OVER w{n}, NULL) AS news_volume_volatility_{n}d" for n in (7, 14, 30))},
  {", ".join(f"news_volume - lag(news_volume, {k}) OVER w AS news_volume_momentum_{k}d, (news_volume - lag(news_volume, {k}) OVER w) / lag(news_volume, {k}) OVER w * 100.0 AS news_volume_roc_{k}d" for k in (1, 3, 7))},
  {", ".join(f"{a} / news_volume AS {a}_per_volume, {a} - lag({a}, 3) OVER w AS {a}_momentum_3d, {a} - lag({a}, 7) OVER w AS {a}_momentum_7d, {a} / avg({a}) OVER w7 AS {a}_concentration_7d, {a} / avg({a}) OVER w14 AS {a}_concentration_14d" for a in _att)},
  CAST(sum(news_volume) OVER w7 AS BIGINT) AS cumulative_attention_7d, CAST(sum(news_volume) OVER w30 AS BIGINT) AS cumulative_attention_30d,
  quantile_cont(news_volume, 0.5) OVER w90 AS med FROM b0 {wins(7, 14, 30, 90)}),
v1 AS (SELECT *, {", ".join(f"news_volume / news_volume_ma_{n}d AS news_volume_ratio_{n}d, {_rank(n)} AS news_volume_percentile_{n}d, {fl(f'news_volume > news_volume_ma_{n}d')} AS news_volume_above_avg_{n}d" for n in (7, 30, 90))},
  {", ".join(f"news_volume_volatility_{n}d / news_volume_ma_{n}d AS news_volume_cv_{n}d" for n in (7, 14, 30))},
  {fl("news_volume > news_volume_ma_30d + 2 * news_volume_volatility_30d")} AS news_volume_spike,
  {fl("news_volume > news_volume_ma_30d + 3 * news_volume_volatility_30d")} AS news_volume_major_spike,
  {fl("news_volume < news_volume_ma_30d - news_volume_volatility_30d")} AS news_volume_dry_spell, {fl("news_volume = 0")} AS zero_news_day,
  (news_volume - news_volume_ma_7d) / (CASE WHEN news_volume_volatility_7d = 0 THEN 1 ELSE news_volume_volatility_7d END) AS news_surprise_score,
  list_dot_product(CAST(l7 AS DOUBLE[]), list_slice({_decay}, 1, len(l7))) / list_sum(list_slice({_decay}, 1, len(l7))) AS attention_decay_score,
  {fl("news_volume > med * 1.5")} AS high_attention_regime, {fl("news_volume < med * 0.5")} AS low_attention_regime FROM v0),
v2 AS (SELECT *, CASE WHEN news_volume_spike IS DISTINCT FROM lag(news_volume_spike) OVER w THEN 1 ELSE 0 END AS t1,
  CASE WHEN news_volume_dry_spell IS DISTINCT FROM lag(news_volume_dry_spell) OVER w THEN 1 ELSE 0 END AS t2 FROM v1 {wins()}),
v3 AS (SELECT *, sum(t1) OVER cum AS g1, sum(t2) OVER cum AS g2 FROM v2 {wins()}),
res AS (SELECT *, CAST(sum(news_volume_spike) OVER (PARTITION BY symbol, g1 ORDER BY ts) AS BIGINT) AS consecutive_high_volume,
  CAST(sum(news_volume_dry_spell) OVER (PARTITION BY symbol, g2 ORDER BY ts) AS BIGINT) AS consecutive_low_volume,
  {fl("news_surprise_score > 2")} AS positive_news_surprise, {fl("news_surprise_score < -1")} AS negative_news_surprise,
  CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(isodow(ts) > 5 AS INTEGER) AS is_weekend, CAST(isodow(ts) = 1 AS INTEGER) AS is_monday,
  CAST(isodow(ts) = 5 AS INTEGER) AS is_friday FROM v3)"""


_VOLUME = (
    [
        *[f"news_volume_above_avg_{n}d" for n in (7, 30, 90)], "news_volume_spike", "news_volume_major_spike", "news_volume_dry_spell",
        "zero_news_day", "consecutive_high_volume", "consecutive_low_volume", "positive_news_surprise", "negative_news_surprise",
        "high_attention_regime", "low_attention_regime", "day_of_week", "is_weekend", "is_monday", "is_friday",
        "cumulative_attention_7d", "cumulative_attention_30d",
    ],
    [
        *[f"news_volume_{s}_{n}d" for s in ("ma", "ratio", "percentile") for n in (7, 30, 90)],
        *[f"news_volume_{s}_{n}d" for s in ("volatility", "cv") for n in (7, 14, 30)],
        *[f"news_volume_{s}_{k}d" for s in ("momentum", "roc") for k in (1, 3, 7)],
        *[f"{a}_{s}" for a in _att for s in ("per_volume", "momentum_3d", "momentum_7d", "concentration_7d", "concentration_14d")],
        "news_surprise_score", "attention_decay_score",
    ],
)


@query("news_volume", Shape(["symbol"], ["ts"], *_VOLUME), _volume_sql)
def news_volume(spark, sf):
    return sen.news_volume_table(_days(spark, sf))


@query(
    "sentiment_interactions",
    Shape(["symbol"], ["ts"], ["sentiment_feature_count"], ["sentiment_data_quality"], ["sentiment_volume_weighted", "sentiment_intensity_high_volume", "sentiment_volume_adjusted"]),
    f"""{_BASE},
i0 AS (SELECT *, list(news_volume) OVER w30 AS l30, quantile_cont(news_volume, 0.5) OVER (PARTITION BY symbol) AS med, row_number() OVER w AS rn FROM b0 {wins(30)}),
res AS (SELECT *, sentiment_mean * ln(1 + news_volume) AS sentiment_volume_weighted,
  CASE WHEN news_volume > med THEN abs(sentiment_mean) ELSE 0 END AS sentiment_intensity_high_volume, sentiment_mean * {_rank(30)} AS sentiment_volume_adjusted,
  23 AS sentiment_feature_count, (23 - (rn <= 3)::INT - (rn <= 7)::INT) / 23.0 AS sentiment_data_quality FROM i0)""",
)
def sentiment_interactions(spark, sf):
    return sen.sentiment_features(_days(spark, sf), momentum=False)


_INTERACTIONS = ["sentiment_volume_weighted", "sentiment_intensity_high_volume", "sentiment_volume_adjusted"]
# features that early days lack: all of momentum, and the changes of the count
_GAPS = [c for part in _MOMENTUM for c in part] + ["sentiment_count_momentum_3d", "sentiment_count_momentum_7d"]
_FEATURES = 79  # columns with sentiment in their name, the mean left out
_full_sql = f"""{_momentum_sql.replace("res AS (", "mres AS (")},
{_volume_sql.removeprefix(_BASE + ",").replace("res AS (", "vres AS (")},
i0 AS (SELECT symbol, ts, sentiment_mean * ln(1 + news_volume) AS sentiment_volume_weighted,
  CASE WHEN news_volume > quantile_cont(news_volume, 0.5) OVER (PARTITION BY symbol) THEN abs(sentiment_mean) ELSE 0 END AS sentiment_intensity_high_volume FROM b0),
ires AS (SELECT i0.*, sentiment_mean * news_volume_percentile_30d AS sentiment_volume_adjusted FROM i0 JOIN vres USING (symbol, ts)),
ares AS (SELECT m.*, v.* EXCLUDE (symbol, ts, sentiment_mean, news_volume, sentiment_count, source_diversity), i.* EXCLUDE (symbol, ts)
  FROM mres m JOIN vres v ON v.symbol = m.symbol AND v.ts = m.ts JOIN ires i ON i.symbol = m.symbol AND i.ts = m.ts),
res AS (SELECT *, {_FEATURES} AS sentiment_feature_count, ({_FEATURES} - ({" + ".join(f"({c} IS NULL)::INT" for c in _GAPS)})) / {_FEATURES}.0 AS sentiment_data_quality FROM ares)"""


@query(
    "sentiment_full_features",
    Shape(["symbol"], ["ts"], [*_MOMENTUM[0], *_VOLUME[0], "sentiment_feature_count"], [*_MOMENTUM[1], *_VOLUME[1], "sentiment_data_quality"], [*_MOMENTUM[2], *_INTERACTIONS]),
    _full_sql,
)
def sentiment_full_features(spark, sf):
    return sen.sentiment_features(_days(spark, sf))


def _pair(a: str, b: str, n: int) -> str:
    ok = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return f"""CASE WHEN count(*) FILTER (WHERE {ok}) OVER w{n} = {n} AND min({a}) OVER w{n} < max({a}) OVER w{n}
      AND min({b}) OVER w{n} < max({b}) OVER w{n} THEN corr({a}, {b}) OVER w{n} END"""


@query(
    "sentiment_market_alignment",
    Shape(
        ["symbol"], ["ts"], [],
        [
            "returns", *[f"sentiment_return_corr_{n}d" for n in (5, 10, 20)], *[f"sentiment_direction_agreement_{n}d" for n in (5, 10, 20)],
            *[f"sentiment_{s}_corr_{k}d" for s in ("lead", "lag") for k in (1, 2, 3)],
        ],
    ),
    f"""{_BASE},{UBARS},
j AS (SELECT symbol, ts, sentiment_mean AS s, close, close / lag(close) OVER w - 1 AS returns FROM b0 JOIN ubars USING (symbol, ts) {wins()}),
k AS (SELECT *, {", ".join(f"lead(returns, {k}) OVER w AS n{k}, lag(returns, {k}) OVER w AS p{k}" for k in (1, 2, 3))},
  CASE WHEN sign(s) = sign(returns) THEN 1.0 ELSE 0.0 END AS same FROM j {wins()}),
res AS (SELECT *, {", ".join(f"{_pair('s', 'returns', n)} AS sentiment_return_corr_{n}d, {full(n, 'same', f'avg(same) OVER w{n}')} AS sentiment_direction_agreement_{n}d" for n in (5, 10, 20))},
  {", ".join(f"{_pair('s', f'n{k}', 20)} AS sentiment_lead_corr_{k}d, {_pair('s', f'p{k}', 20)} AS sentiment_lag_corr_{k}d" for k in (1, 2, 3))} FROM k {wins(5, 10, 20)})""",
)
def sentiment_market_alignment(spark, sf):
    return sen.sentiment_market_alignment(_days(spark, sf), fx.user_bars(spark, sf))


# ------------------------------------------------------------ bucketed alignment
_METHODS = {
    "mean": "avg(sentiment_score)",
    "weighted": "sum(confidence * sentiment_score) / NULLIF(sum(confidence), 0)",
    "ewm": "sum(sentiment_score * pow(0.5, date_diff('microsecond', ts, tl) / (86400e6 * 0.8))) / sum(pow(0.5, date_diff('microsecond', ts, tl) / (86400e6 * 0.8)))",
    "last": "last(sentiment_score ORDER BY ts, event_id)",
}


def _exact_news(spark, sf):
    return fx.news(spark, sf).withColumns({"sentiment_score": F.round(C("sentiment_score") * 100), "confidence": F.round(C("confidence") * 100)})


def _align_sql(expr: str) -> str:
    return f"""{NEWS},{UBARS}, {_EXACT_NEWS},
e1 AS (SELECT *, CAST(ts AS DATE) AS day, max(ts) OVER (PARTITION BY symbol, CAST(ts AS DATE)) AS tl FROM en),
bk AS (SELECT symbol, day, {expr} AS v FROM e1 GROUP BY 1, 2),
gd AS (SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM bk GROUP BY 1),
ff AS (SELECT g.symbol, g.day, last_value(b.v IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.day ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS sentiment_score
  FROM gd g LEFT JOIN bk b ON g.symbol = b.symbol AND g.day = b.day),
mj AS (SELECT u.symbol, u.ts, u.close, f.sentiment_score FROM ubars u LEFT JOIN ff f ON f.symbol = u.symbol AND f.day = u.ts),
mk AS (SELECT *, {full(3, "sentiment_score", "avg(sentiment_score) OVER w3")} AS sentiment_ma_3d, {full(7, "sentiment_score", "avg(sentiment_score) OVER w7")} AS sentiment_ma_7d,
  {full(7, "sentiment_score", "stddev_samp(sentiment_score) OVER w7")} AS sentiment_volatility,
  last_value(CASE WHEN sentiment_score IS NOT NULL THEN ts END IGNORE NULLS) OVER cum AS seen FROM mj {wins(3, 7)}),
res AS (SELECT *, sentiment_score - sentiment_ma_7d AS sentiment_momentum, coalesce(date_diff('hour', seen, ts), 0) AS sentiment_age_hours FROM mk)"""


def _register(method: str, expr: str) -> None:
    name = {"weighted": "weighted_mean"}.get(method, method)

    @query(
        f"align_sentiment_{method}",
        Shape(["symbol"], ["ts"], [], ["sentiment_age_hours"], ["close", "sentiment_score", "sentiment_ma_3d", "sentiment_ma_7d", "sentiment_momentum", "sentiment_volatility"]),
        _align_sql(expr),
    )
    def run(spark, sf):
        return sen.align_sentiment(fx.user_bars(spark, sf), _exact_news(spark, sf), name, tie=["event_id"])


for _name, _expr in _METHODS.items():
    _register(_name, _expr)


@query(
    "sentiment_coverage",
    Shape([], [], [], ["coverage_pct"]),
    f"{_align_sql(_METHODS['mean']).replace('res AS (', 'r0 AS (')}, res AS (SELECT count(sentiment_score) / count(*) * 100 AS coverage_pct FROM r0)",
)
def sentiment_coverage(spark, sf):
    return sen.sentiment_coverage(sen.align_sentiment(fx.user_bars(spark, sf), _exact_news(spark, sf)))


@query(
    "model_sentiment_join",
    Shape(["symbol"], ["ts"], ["news_volume", "llm_count_llm"], [], ["sentiment_mean", "llm_mean_llm", "fallback"]),
    f"""{_BASE},
l AS (SELECT symbol, CAST(ts AS DATE) AS ts, avg(CAST(round(confidence * 100) AS DOUBLE)) AS m, count(*) AS k FROM news WHERE source = 'purchase' GROUP BY 1, 2),
res AS (SELECT b.*, coalesce(l.m, 0) AS llm_mean_llm, coalesce(l.k, 0) AS llm_count_llm, 0.9 * sentiment_mean AS fallback FROM b0 b LEFT JOIN l USING (symbol, ts))""",
)
def model_sentiment_join(spark, sf):
    scored = fx.news(spark, sf).filter(C("source") == "purchase")
    llm = scored.groupBy("symbol", F.to_date("ts").alias("ts")).agg(F.avg(F.round(C("confidence") * 100)).alias("llm_mean"), F.count(F.lit(1)).alias("llm_count"))
    joined = joins.join_llm_daily(_days(spark, sf), llm)
    return sen.model_sentiment_fallback(joined, "sentiment_mean").withColumn("fallback", C("llm_sentiment_mean"))


@query(
    "sentiment_summary",
    Shape(["symbol"], [], ["total_articles", "days"], [], ["average_sentiment", "sentiment_volatility"]),
    f"""{_BASE},
res AS (SELECT symbol, avg(sentiment_mean) AS average_sentiment, stddev_samp(sentiment_mean) AS sentiment_volatility, CAST(sum(news_volume) AS BIGINT) AS total_articles,
  count(*) AS days FROM b0 GROUP BY 1)""",
)
def sentiment_summary(spark, sf):
    return sen.sentiment_summary(_days(spark, sf))


@query(
    "score_histogram",
    Shape([], [], ["bin", "n"]),
    f"""{NEWS}, {_EXACT_NEWS},
res AS (SELECT CAST(least(floor((sentiment_score + 100) / 10) + 1, 20) AS BIGINT) AS bin, count(*) AS n FROM en GROUP BY 1)""",
)
def score_histogram(spark, sf):
    return sen.score_histogram(_exact_news(spark, sf), lo=-100.0, hi=100.0)


@query(
    "smoothed_sentiment",
    Shape(["symbol"], ["ts"], [], [], ["sentiment_mean", "smoothed"]),
    f"""{_BASE},
res AS (SELECT *, CASE WHEN count(*) OVER c = 7 THEN avg(sentiment_mean) OVER c END AS smoothed FROM b0
  WINDOW c AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))""",
)
def smoothed_sentiment(spark, sf):
    return sen.smoothed_daily(_days(spark, sf), "sentiment_mean")


