"""Streaming jobs over the driver tables, fed in stretches of time and drained into a table each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch, written
from ..streaming import jobs
from . import fixtures as fx
from .catalog import Shape, query
from .sqlkit import ema_chain

C = F.col


def _replay(table, ts, job):
    return jobs.replay(table, ts, job, scratch(table.sparkSession, "stream"))


@query(
    "stream_daily_sentiment",
    Shape(
        ["symbol"], ["date"], ["news_volume", "positive_sentiment_count", "negative_sentiment_count"],
        ["sentiment_mean", "sentiment_std", "sentiment_min", "sentiment_max"],
    ),
    f"""{fx.NEWS_SQL},
res AS (SELECT symbol, CAST(ts AS DATE) AS date, avg(s) AS sentiment_mean, stddev_samp(s) AS sentiment_std, min(s) AS sentiment_min, max(s) AS sentiment_max,
  count(*) AS news_volume, count(*) FILTER (WHERE s > 10) AS positive_sentiment_count, count(*) FILTER (WHERE s < -10) AS negative_sentiment_count
  FROM (SELECT *, round(sentiment_score * 100) AS s FROM news)
  WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM news) GROUP BY 1, 2)""",
)
def stream_daily_sentiment(spark, sf):
    """Days the watermark has closed, a day before the last event."""
    news = fx.news(spark, sf).select("symbol", C("ts").cast("timestamp").alias("ts"), F.round(C("sentiment_score") * 100).alias("sentiment_score"))
    return _replay(news, "ts", lambda s: jobs.daily_sentiment_stream(s, strong=10))


@query(
    "stream_first_articles",
    Shape(["url"], [], [], times=["publishedAt"]),
    f"{fx.ARTICLES_SQL}, res AS (SELECT DISTINCT url, publishedAt FROM articles)",
)
def stream_first_articles(spark, sf):
    """Every url once; its articles share a time, so none comes again after the watermark has let it go."""
    found = fx.articles(spark, sf).select("url", C("publishedAt").cast("timestamp").alias("publishedAt"))
    return _replay(found, "publishedAt", jobs.first_articles)


@query(
    "stream_bars",
    Shape(["symbol"], [], [], ["volume"], ["open", "high", "low", "close"], times=["ts"]),
    f"""{fx.TICKS_SQL},
res AS (SELECT symbol, date_trunc('hour', ts) AS ts, first(close ORDER BY ticks.ts, event_id) AS open, max(close) AS high, min(close) AS low,
  last(close ORDER BY ticks.ts, event_id) AS close, sum(volume) AS volume
  FROM ticks WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 5 MINUTE FROM ticks) GROUP BY 1, 2)""",
)
def stream_bars(spark, sf):
    """Hourly bars under five heavy keys; the state of an open bar is one row, summed in the tasks before the shuffle."""
    quotes = fx.ticks(spark, sf).withColumn("ts", C("ts").cast("timestamp"))
    return _replay(quotes, "ts", lambda s: jobs.minute_bars(s, width="1 hour", price="close", size="volume", seq="event_id"))


_GAP, _LATE = 10, 5
_STATE_SQL = f"""{fx.BARS_SQL},
st AS (SELECT *, CASE WHEN date_diff('day', lag(ts) OVER w, ts) > {_GAP} THEN 1 ELSE 0 END AS fresh FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
sn AS (SELECT symbol AS sym, symbol || '/' || sum(fresh) OVER (PARTITION BY symbol ORDER BY ts) AS symbol, ts, close, volume FROM st),
{ema_chain("sn", {"ema": ("close", 12)}, "se")},
sv AS (SELECT *, coalesce(sum(CASE WHEN d > 0 THEN volume WHEN d < 0 THEN -volume ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts), 0) AS obv
  FROM (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM se)),
res AS (SELECT sym AS symbol, ts, close, ema, obv FROM sv WHERE ts <= (SELECT max(ts) - INTERVAL {_LATE} DAY FROM bars))"""


@query("stream_running_state", Shape(["symbol"], ["ts"], [], ["obv"], ["close", "ema"]), _STATE_SQL)
def stream_running_state(spark, sf):
    """EMA and OBV in event-time order; a supplier without bars for ten days starts afresh."""
    bars = fx.bars(spark, sf).select("symbol", C("ts").cast("timestamp").alias("ts"), "close", "volume")
    # bars are an aggregate: written once, as each stretch of time reads them
    return _replay(written(bars), "ts", lambda s: jobs.ordered_state(s, late=f"{_LATE} days", idle=f"{_GAP} days"))
