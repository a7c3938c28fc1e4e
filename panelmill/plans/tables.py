"""Tables written and read back: bars by month, day summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch, written
from ..sources import market, news, sinks
from . import fixtures as fx
from .catalog import Shape, query

C = F.col
_FROM, _TO = "1996-03-10", "1997-02-20"
_FIX_FROM, _FIX_TO = "1996-06-01", "1996-07-31"


@query(
    "bar_table",
    Shape(["symbol"], ["ts"], [], ["volume"], ["open", "high", "low", "close"]),
    f"""{fx.BARS_SQL},
res AS (SELECT symbol, ts, open, high, low, close, CASE WHEN ts BETWEEN DATE '{_FIX_FROM}' AND DATE '{_FIX_TO}' THEN volume * 2 ELSE volume END AS volume
  FROM bars WHERE ts BETWEEN DATE '{_FROM}' AND DATE '{_TO}')""",
)
def bar_table(spark, sf):
    """A year of bars from a table by month, two months of which were written again with corrected volumes."""
    path = scratch(spark, "bars")
    bars = written(fx.bars(spark, sf))
    sinks.write_bar_table(bars, path)
    again = market.in_range(bars, _FIX_FROM, _FIX_TO).withColumn("volume", C("volume") * 2)
    sinks.write_bar_table(again, path)
    return market.read_bar_table(spark, path, None, _FROM, _TO)


@query(
    "bar_table_symbols",
    Shape(["symbol"], [], ["days"], ["volume"]),
    f"""{fx.BARS_SQL},
res AS (SELECT symbol, count(*) AS days, sum(volume) AS volume FROM bars WHERE ts >= DATE '{_FROM}' AND symbol IN ('S1', 'S2', 'S7') GROUP BY 1)""",
)
def bar_table_symbols(spark, sf):
    """Several symbols in one read of the table."""
    path = scratch(spark, "bars")
    sinks.write_bar_table(fx.bars(spark, sf), path)
    return market.read_bar_table(spark, path, ["S1", "S2", "S7"], _FROM).groupBy("symbol").agg(F.count(F.lit(1)).alias("days"), F.sum("volume").alias("volume"))


def _lengths(texts: list[str]) -> str:
    """A summary that shows what it was made of: number of texts, and first and last words."""
    return f"{len(texts)} texts, {sum(map(len, texts))} characters|{texts[0][:12]}|{texts[-1][:12]}"


@query(
    "day_summaries",
    Shape(["doc_id"], [], ["summary_sha"]),
    f"""{fx.ARTICLES_SQL},
tx AS (SELECT doc_id, publishedAt, url, lang, title || ' ' || description AS text FROM articles),
ds AS (SELECT lang, publishedAt, count(*) || ' texts, ' || sum(length(text)) || ' characters' AS head,
  first(substr(text, 1, 12) ORDER BY url, text) AS a, last(substr(text, 1, 12) ORDER BY url, text) AS b FROM tx GROUP BY 1, 2),
res AS (SELECT doc_id, sha256(head || '|' || a || '|' || b) AS summary_sha FROM tx JOIN ds ON tx.lang IS NOT DISTINCT FROM ds.lang AND tx.publishedAt = ds.publishedAt)""",
)
def day_summaries(spark, sf):
    """Every article with the summary of its day and language, made by one call over whole titles and texts."""
    articles = fx.articles(spark, sf).select("doc_id", "lang", "publishedAt", "url", "title", "description")
    made = news.summarise_days(articles, _lengths, key=("lang",), per_call=1_000_000)
    return made.select("doc_id", F.sha2("daily_summary", 256).alias("summary_sha"))
