"""Fill, clean, calendar and feature-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.axis import DAILY, Axis, in_blocks
from ..operators import calendar as cal
from ..operators import clean
from ..sources import market, news
from . import fixtures as fx
from .catalog import Shape, query
from .sqlkit import full, wins

C = F.col
BARS, HBARS = fx.BARS_SQL, fx.HOUR_BARS_SQL

# an hourly calendar per user: quiet hours are the gaps
_GRID = f"""{HBARS},
span AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM hbars GROUP BY 1),
slots AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span),
gaps AS (SELECT s.symbol, s.ts, b.close, b.volume FROM slots s LEFT JOIN hbars b USING (symbol, ts))"""


def _gaps(spark, sf):
    b = fx.user_bars(spark, sf, "hour")
    return cal.grid(b, "hour").join(b.select("symbol", "ts", "close", "volume"), ["symbol", "ts"], "left")


@query(
    "calendar_fill",
    Shape(["symbol"], [], [], [], ["close", "volume"], ["ts"]),
    f"""{_GRID},
res AS (SELECT symbol, ts, last_value(close IGNORE NULLS) OVER cum AS close, last_value(volume IGNORE NULLS) OVER cum AS volume FROM gaps {wins()})""",
)
def calendar_fill(spark, sf):
    return cal.densify(fx.user_bars(spark, sf, "hour"), ["close", "volume"], "hour")


@query(
    "ffill_limit",
    Shape(["symbol"], [], [], [], ["close", "volume"], ["ts"]),
    f"""{_GRID},
res AS (SELECT symbol, ts, last_value(close IGNORE NULLS) OVER w6 AS close, last_value(volume IGNORE NULLS) OVER w6 AS volume FROM gaps {wins(6)})""",
)
def ffill_limit(spark, sf):
    return clean.handle_missing(_gaps(spark, sf), "forward_fill")


_next = "PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


@query(
    "bfill",
    Shape(["symbol"], [], [], [], ["close", "volume"], ["ts"]),
    f"""{_GRID},
res AS (SELECT symbol, ts, first_value(close IGNORE NULLS) OVER nxt AS close, first_value(volume IGNORE NULLS) OVER nxt AS volume FROM gaps WINDOW nxt AS ({_next}))""",
)
def bfill(spark, sf):
    return clean.back_fill(_gaps(spark, sf), ["close", "volume"])


def _interp(limit: int | None) -> str:
    near = "TRUE" if limit is None else f"rn - prn <= {limit}"
    return f"""{_GRID},
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM gaps),
k AS (SELECT *, last_value(CASE WHEN close IS NOT NULL THEN rn END IGNORE NULLS) OVER cum AS prn, last_value(close IGNORE NULLS) OVER cum AS pv,
  first_value(CASE WHEN close IS NOT NULL THEN rn END IGNORE NULLS) OVER nxt AS nrn, first_value(close IGNORE NULLS) OVER nxt AS nv
  FROM n {wins(extra=f", nxt AS ({_next})")}),
res AS (SELECT symbol, ts, coalesce(close, CASE WHEN {near} THEN pv + coalesce((nv - pv) * (rn - prn)::DOUBLE / NULLIF(nrn - prn, 0), 0) END) AS close FROM k)"""


@query("interpolate", Shape(["symbol"], [], [], [], ["close"], ["ts"]), _interp(None))
def interpolate(spark, sf):
    return clean.interpolate(_gaps(spark, sf), ["close"])


@query("interpolate_limit", Shape(["symbol"], [], [], [], ["close"], ["ts"]), _interp(5))
def interpolate_limit(spark, sf):
    return clean.handle_missing(_gaps(spark, sf).drop("volume"), "interpolate")


@query(
    "mean_fill",
    Shape(["symbol"], [], [], [], ["close", "volume"], ["ts"]),
    f"""{_GRID},
res AS (SELECT symbol, ts, coalesce(close, avg(close) OVER (PARTITION BY symbol)) AS close, coalesce(volume, avg(volume) OVER (PARTITION BY symbol)) AS volume FROM gaps)""",
)
def mean_fill(spark, sf):
    return clean.handle_missing(_gaps(spark, sf), "mean")


@query("drop_missing", Shape(["symbol"], [], [], [], ["close", "volume"], ["ts"]), f"{_GRID}, res AS (SELECT * FROM gaps WHERE close IS NOT NULL)")
def drop_missing(spark, sf):
    return clean.handle_missing(_gaps(spark, sf), "drop")


@query(
    "missing_counts",
    Shape(["symbol"], [], ["missing_count"], ["missing_pct"], [], ["ts"]),
    f"""{_GRID},
c AS (SELECT *, CAST(close IS NULL AS INTEGER) + CAST(volume IS NULL AS INTEGER) AS missing_count FROM gaps),
res AS (SELECT *, missing_count / 5.0 AS missing_pct FROM c)""",
)
def missing_counts(spark, sf):
    return clean.add_missing_counts(_gaps(spark, sf))


@query(
    "null_counts",
    Shape(["column"], [], ["nulls"]),
    f"""{_GRID},
res AS (SELECT 'symbol' AS "column", count(*) - count(symbol) AS nulls FROM gaps UNION ALL SELECT 'ts', count(*) - count(ts) FROM gaps
  UNION ALL SELECT 'close', count(*) - count(close) FROM gaps UNION ALL SELECT 'volume', count(*) - count(volume) FROM gaps)""",
)
def null_counts(spark, sf):
    return clean.null_counts(_gaps(spark, sf))


# ------------------------------------------------------------ calendar
@query(
    "business_days",
    Shape(["symbol"], ["ts"], [], [], ["close", "volume"]),
    f"""{BARS},
span AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY 1),
days AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ts FROM span),
res AS (SELECT d.symbol, d.ts, b.close, b.volume FROM days d ASOF LEFT JOIN bars b ON d.symbol = b.symbol AND d.ts >= b.ts WHERE isodow(d.ts) < 6)""",
)
def business_days(spark, sf):
    return cal.to_business_days(fx.bars(spark, sf), ["close", "volume"])


@query(
    "daily_densify",
    Shape(["symbol"], ["ts"], [], [], ["close"]),
    f"""{BARS},
span AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY 1),
days AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ts FROM span),
res AS (SELECT d.symbol, d.ts, last_value(b.close IGNORE NULLS) OVER (PARTITION BY d.symbol ORDER BY d.ts) AS close FROM days d LEFT JOIN bars b USING (symbol, ts))""",
)
def daily_densify(spark, sf):
    return cal.as_frequency(fx.bars(spark, sf), ["close"])


@query(
    "resample_4h",
    Shape(["symbol"], [], [], ["avg_close"], ["last_close"], ["ts"]),
    f"""{HBARS},
f AS (SELECT *, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '2000-01-01') AS slot FROM hbars),
a AS (SELECT symbol, slot AS ts, avg(close) AS avg_close, last(close ORDER BY ts) AS last_close FROM f GROUP BY symbol, slot),
s AS (SELECT symbol, unnest(generate_series(min(slot), max(slot), INTERVAL 4 HOURS)) AS ts FROM f GROUP BY symbol),
res AS (SELECT s.symbol, s.ts, a.avg_close, a.last_close FROM s LEFT JOIN a USING (symbol, ts))""",
)
def resample_4h(spark, sf):
    aggs = [F.avg("close").alias("avg_close"), F.max_by("close", "ts").alias("last_close")]
    return cal.resample(fx.user_bars(spark, sf, "hour"), aggs, "4 hours")


@query(
    "future_business_days",
    Shape(["symbol"], ["ts"], ["step"]),
    f"""{BARS},
l AS (SELECT symbol, max(ts) AS last FROM bars GROUP BY 1),
dd AS (SELECT symbol, CAST(last + to_days(CAST(i AS INTEGER)) AS DATE) AS ts FROM l, generate_series(1, 20) g(i)),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS INTEGER) AS step FROM dd WHERE isodow(ts) < 6),
res AS (SELECT * FROM n WHERE step <= 10)""",
)
def future_business_days(spark, sf):
    return cal.future_business_days(fx.bars(spark, sf), 10)


# ------------------------------------------------------------ cleaning
@query(
    "dedup_clean",
    Shape(["symbol"], ["ts"], [], [], ["open", "high", "low", "close", "volume"]),
    f"""{BARS},{fx.FAULTY_SQL},
one AS (SELECT * FROM faulty WHERE copy = 1),
res AS (SELECT symbol, ts, open, high, low, volume, coalesce(last_value(close IGNORE NULLS) OVER cum, first_value(close IGNORE NULLS) OVER nxt) AS close
  FROM one {wins(extra=f", nxt AS ({_next})")})""",
)
def dedup_clean(spark, sf):
    return clean.clean_market_data(fx.faulty_bars(spark, sf).drop("rn"), order=["copy"])


@query(
    "final_cleanup",
    Shape(["symbol"], ["ts"], [], [], ["close", "bad_ratio"]),
    f"""{BARS},{fx.FAULTY_SQL},
one AS (SELECT *, CASE WHEN volume > 0 THEN close / volume END AS bad_ratio FROM faulty WHERE copy = 1),
res AS (SELECT symbol, ts, close, bad_ratio FROM one)""",
)
def final_cleanup(spark, sf):
    f = fx.faulty_bars(spark, sf).withColumns(
        {
            "bad_ratio": F.when(C("volume") > 0, C("close") / C("volume")).otherwise(F.lit(float("inf"))),
            "mostly_missing": F.when(C("rn") % 3 == 0, C("close")),
        }
    )
    out = clean.final_cleanup(f, order=["copy"])
    if "mostly_missing" in out.columns:
        raise AssertionError("a column with two thirds missing must be dropped")
    return out


# ------------------------------------------------------------ features
CALENDAR_SQL = """CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(day(ts) AS INTEGER) AS day_of_month, CAST(weekofyear(ts) AS INTEGER) AS week_of_year,
  CAST(month(ts) AS INTEGER) AS month, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(year(ts) AS INTEGER) AS year,
  CAST(isodow(ts) = 1 AS INTEGER) AS is_monday, CAST(isodow(ts) = 5 AS INTEGER) AS is_friday, CAST(day(ts) = 1 AS INTEGER) AS is_month_start,
  CAST(ts = last_day(ts) AS INTEGER) AS is_month_end, CAST(ts = date_trunc('quarter', ts) AS INTEGER) AS is_quarter_start,
  CAST(ts = last_day(CAST(date_trunc('quarter', ts) + INTERVAL 2 MONTHS AS DATE)) AS INTEGER) AS is_quarter_end"""


@query(
    "lags_and_calendar",
    Shape(
        ["symbol"], ["ts"],
        [
            "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year", "is_monday", "is_friday", "is_month_start", "is_month_end",
            "is_quarter_start", "is_quarter_end",
        ],
        [f"returns_lag_{k}" for k in (1, 2, 3, 5, 10)], [f"close_lag_{k}" for k in (1, 2, 3, 5, 10)],
    ),
    f"""{BARS},
r AS (SELECT *, close / lag(close) OVER w - 1 AS returns FROM bars {wins()}),
res AS (SELECT *, {", ".join(f"lag(close, {k}) OVER w AS close_lag_{k}, lag(returns, {k}) OVER w AS returns_lag_{k}" for k in (1, 2, 3, 5, 10))},
  {CALENDAR_SQL} FROM r {wins()})""",
)
def lags_and_calendar(spark, sf):
    b = fx.bars(spark, sf).withColumn("returns", DAILY.pct("close"))
    return clean.temporal_features(clean.lag_columns(b, ["returns", "close"]))


_lag_cols = ("open", "high", "low", "close", "volume")
_mlags = (1, 2, 3, 5, 10, 20)


@query(
    "model_lag_features",
    Shape(
        ["symbol"], ["ts"], ["day_of_week", "day_of_month", "month", "quarter", "is_monday", "is_friday"],
        [f"{c}_return_lag_{k}" for c in _lag_cols[:4] for k in _mlags],
        [f"{c}_lag_{k}" for c in _lag_cols for k in _mlags] + [f"close_rolling_{s}_{n}" for s in ("mean", "std", "max", "min") for n in (5, 10, 20)],
    ),
    f"""{BARS},
r AS (SELECT *, {", ".join(f"{c} / lag({c}) OVER w - 1 AS {c}_ret" for c in _lag_cols[:4])} FROM bars {wins()}),
res AS (SELECT *, {", ".join(f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for c in _lag_cols for k in _mlags)},
  {", ".join(f"lag({c}_ret, {k}) OVER w AS {c}_return_lag_{k}" for c in _lag_cols[:4] for k in _mlags)},
  {", ".join(f"{full(n, 'close', f'{fn}(close) OVER w{n}')} AS close_rolling_{s}_{n}" for n in (5, 10, 20) for s, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")))},
  CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(day(ts) AS INTEGER) AS day_of_month, CAST(month(ts) AS INTEGER) AS month,
  CAST(quarter(ts) AS INTEGER) AS quarter, CAST(isodow(ts) = 1 AS INTEGER) AS is_monday, CAST(isodow(ts) = 5 AS INTEGER) AS is_friday
  FROM r {wins(5, 10, 20)})""",
)
def model_lag_features(spark, sf):
    return clean.model_time_features(clean.model_lag_features(fx.bars(spark, sf)))


@query(
    "log_transform",
    Shape(["symbol"], ["ts"], [], ["log_value", "log_shift"], ["restored"]),
    f"""{BARS},
m AS (SELECT symbol, ts, close - 1000 AS y, min(close - 1000) OVER (PARTITION BY symbol) AS lo FROM bars),
s AS (SELECT *, CASE WHEN lo <= 0 THEN abs(lo) + 1e-8 ELSE 0.0 END AS log_shift FROM m),
res AS (SELECT symbol, ts, ln(y + log_shift) AS log_value, log_shift, y AS restored FROM s)""",
)
def log_transform(spark, sf):
    b = fx.bars(spark, sf).withColumn("y", C("close") - 1000)
    return clean.inverse_log(clean.log_transform(b, "y"), "log_value", "restored")


@query(
    "chronological_split",
    Shape(["symbol"], ["ts"], ["split"]),
    f"""{BARS},
n AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars {wins()}),
res AS (SELECT symbol, ts, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM n)""",
)
def chronological_split(spark, sf):
    return clean.chronological_split(fx.bars(spark, sf))


@query(
    "tick_split_fill",
    Shape(["symbol"], [], ["event_id", "split"], [], ["close", "filled_ahead", "line"]),
    f"""{fx.TICKS_SQL},
h AS (SELECT symbol, event_id, ts, CASE WHEN event_id % 7 < 5 THEN close END AS c0, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n
  FROM ticks {wins(order="ts, event_id")}),
k AS (SELECT *, last_value(CASE WHEN c0 IS NOT NULL THEN rn END IGNORE NULLS) OVER cum AS prn, last_value(c0 IGNORE NULLS) OVER cum AS pv,
  first_value(CASE WHEN c0 IS NOT NULL THEN rn END IGNORE NULLS) OVER nxt AS nrn, first_value(c0 IGNORE NULLS) OVER nxt AS nv FROM h
  {wins(order="ts, event_id", extra=", nxt AS (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")}),
res AS (SELECT symbol, event_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split, pv AS close, nv AS filled_ahead,
  coalesce(c0, pv + coalesce((nv - pv) * (rn - prn)::DOUBLE / NULLIF(nrn - prn, 0), 0)) AS line FROM k)""",
)
def tick_split_fill(spark, sf):
    """Fills and splits on keys that each hold a fifth of all rows, through the blocked layout."""
    t = fx.ticks(spark, sf).withColumn("close", F.when(C("event_id") % 7 < 5, C("close")))
    t = t.select("symbol", "ts", "event_id", "close", C("close").alias("filled_ahead"), C("close").alias("line"))

    def work(df, axis: Axis):
        df = clean.chronological_split(df, 0.8, axis)
        df = clean.forward_fill(df, ["close"], axis)
        df = clean.back_fill(df, ["filled_ahead"], axis)
        return clean.interpolate(df, ["line"], axis)

    return in_blocks(t, fx.TICKS, work, before=0)


@query(
    "pad_context",
    Shape(["symbol"], [], ["n"], ["total"], ["oldest", "newest"]),
    f"""{BARS},
t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars),
a AS (SELECT symbol, count(*) AS k, min(rn) AS r0, sum(close) FILTER (WHERE rn <= 512) AS s, max_by(close, rn) FILTER (WHERE rn <= 512) AS f, min_by(close, rn) AS l FROM t GROUP BY 1),
res AS (SELECT symbol, 512 AS n, f AS oldest, l AS newest, s + CASE WHEN k < 512 THEN (512 - k) * f ELSE 0 END AS total FROM a)""",
)
def pad_context(spark, sf):
    arrays = fx.bars(spark, sf).groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "close"))), lambda s: s["close"]).alias("ctx"))
    a = clean.pad_context(arrays, "ctx", 512)
    return a.select(
        "symbol", F.size("ctx").alias("n"), F.aggregate("ctx", F.lit(0.0), lambda x, y: x + y).alias("total"),
        F.element_at("ctx", 1).alias("oldest"), F.element_at("ctx", -1).alias("newest"),
    )


# ------------------------------------------------------------ sources
@query(
    "bars_in_range",
    Shape([], ["o_orderdate"], ["o_orderkey"], [], ["o_totalprice"]),
    """res AS (SELECT * FROM orders WHERE o_orderdate >= '1996-03-01' AND o_orderdate <= '1996-06-30')""",
)
def bars_in_range(spark, sf):
    return market.in_range(fx.table(spark, sf, "orders"), "1996-03-01", "1996-06-30", ts="o_orderdate")


@query(
    "stack_bars",
    Shape(["symbol"], ["ts"], [], [], ["open", "high", "low", "close", "volume"]),
    f"""{BARS}, {fx.USER_BARS_SQL},
res AS (SELECT symbol, ts, open, high, low, close, volume FROM bars
  UNION ALL SELECT symbol, ts, 0.0, high, low, close, 0.0 FROM ubars)""",
)
def stack_bars(spark, sf):
    b = fx.bars(spark, sf).toDF("symbol", "ts", "Open", "High", "Low", "Close", "Volume")
    return market.stack_bars([b, fx.user_bars(spark, sf).drop("open", "volume")])


@query(
    "market_summary",
    Shape(["symbol"], ["ts"], [], ["change_pct"], ["close", "previous_close", "change"]),
    f"""{BARS},
q AS (SELECT *, lag(close) OVER w AS previous_close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars {wins()}),
res AS (SELECT *, close - previous_close AS change, (close / previous_close - 1) * 100 AS change_pct FROM q WHERE rn = 1)""",
)
def market_summary(spark, sf):
    return market.latest_quotes(fx.bars(spark, sf))


@query(
    "stock_info",
    Shape(["symbol"], [], ["name", "sector", "industry", "description"], [], ["market_cap", "dividend_yield", "beta"]),
    """res AS (SELECT 'S' || s_suppkey AS symbol, s_name AS name, coalesce(n_name, 'N/A') AS sector, 'N/A' AS industry, 'N/A' AS description,
  s_acctbal AS market_cap, 0.0 AS dividend_yield, CAST(NULL AS DOUBLE) AS beta FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey)""",
)
def stock_info(spark, sf):
    s, n = fx.table(spark, sf, "supplier"), fx.table(spark, sf, "nation")
    rows = s.join(n, C("s_nationkey") == C("n_nationkey"), "left")
    return market.stock_info(
        rows.select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), C("s_name").alias("name"), C("n_name").alias("sector"), C("s_acctbal").alias("market_cap"))
    )


@query(
    "check_symbols",
    Shape([], [], ["c_custkey", "status"]),
    """res AS (SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) THEN 'valid' ELSE 'invalid' END AS status
  FROM customer)""",
)
def check_symbols(spark, sf):
    wanted = fx.table(spark, sf, "customer").select("c_custkey")
    known = fx.table(spark, sf, "orders").filter(C("o_totalprice") > 300000).select(C("o_custkey").alias("c_custkey"))
    valid, invalid = market.check_symbols(wanted, known, "c_custkey")
    return valid.withColumn("status", F.lit("valid")).unionByName(invalid.withColumn("status", F.lit("invalid")))


@query(
    "merge_articles",
    Shape([], ["publishedAt"], ["url", "source_name", "title", "lang"], [], []),
    f"""{fx.ARTICLES_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY query_ix, publishedAt, source_name, title, description, doc_id) AS rn FROM articles),
res AS (SELECT * FROM k WHERE rn = 1)""",
)
def merge_articles(spark, sf):
    a = news.normalise_articles(fx.articles(spark, sf))
    return news.merge_queries(a.select("publishedAt", "source_name", "title", "description", "url", "doc_id", "lang", "query_ix"))


@query(
    "article_sentiment",
    Shape(["lang"], ["date"], ["article_count"], ["sentiment_negative", "sentiment_neutral", "sentiment_positive", "sentiment_compound", "weighted_sentiment"]),
    f"""{fx.ARTICLES_SQL},
s AS (SELECT lang, CAST(publishedAt AS DATE) AS date, title, 1.0 / (1 + length(t)) AS negative, 0.5 AS neutral, 0.4 AS positive
  FROM (SELECT *, concat_ws(' ', title, description) AS t FROM articles)),
res AS (SELECT lang, date, avg(negative) AS sentiment_negative, avg(neutral) AS sentiment_neutral, avg(positive) AS sentiment_positive,
  avg(positive - negative) AS sentiment_compound, count(title) AS article_count, avg(positive - negative) * ln(1 + count(title)) AS weighted_sentiment
  FROM s GROUP BY 1, 2)""",
)
def article_sentiment(spark, sf):
    """The batched scoring hook with a stand-in scorer, then daily means."""

    def load():
        return lambda texts: [(1.0 / (1 + len(t)), 0.5, 0.4) for t in texts]

    scored = news.score_articles(news.normalise_articles(fx.articles(spark, sf)), load)
    return news.daily_article_sentiment(scored, key=("lang",))


@query(
    "model_sentiment",
    Shape(["lang"], ["date"], ["llm_sentiment_count"], ["llm_sentiment_mean", "llm_sentiment_median", "llm_sentiment_std"]),
    f"""{fx.ARTICLES_SQL},
s AS (SELECT lang, CAST(publishedAt AS DATE) AS date, least(1.0, greatest(-1.0, length(coalesce(title, '') || ' ' || coalesce(description, '')) / 4096.0 - 0.5))::DOUBLE AS x FROM articles),
res AS (SELECT lang, date, avg(x) AS llm_sentiment_mean, quantile_cont(x, 0.5) AS llm_sentiment_median, coalesce(stddev_samp(x), 0) AS llm_sentiment_std,
  count(x) AS llm_sentiment_count FROM s GROUP BY 1, 2)""",
)
def model_sentiment(spark, sf):
    scored = news.score_with_model(fx.articles(spark, sf), lambda: (lambda text: len(text) / 4096.0 - 0.5))
    return news.daily_model_sentiment(scored, key=("lang",))
