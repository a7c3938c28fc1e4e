"""Market-shaped views over the driver tables, in Spark and as SQL.

Every view is derived from whole tables; symbols come from supplier and user
ids, so the number of series grows with the data.  ``bars`` holds one row per
(symbol, day), which bounds a series by the calendar however many line items
were traded.  ``ticks``/``book`` keep one row per event under five event types,
so each key holds about a fifth of all rows: those run on the blocked layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.axis import Axis

C = F.col
ROWS_PER_TASK = 500_000  # under wide features, whose windows cost each task some seconds to set up
SORTED_AGAIN = 2  # views whose readers sort and fold them several times in one task take half of it
TICKS = Axis(key=("symbol",), ts="ts", tie=("event_id",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_symbol(rows: DataFrame, source: DataFrame, shares: int = 1) -> DataFrame:
    """Rows dealt by symbol, ``ROWS_PER_TASK`` of ``source`` to a task (its count reads file footers only), or that over ``shares``.

    Bars, levels, windows and figures by symbol, day or model all follow from this one shuffle, and the share of a task stays the same
    however large the table grows.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-source.count() * shares // ROWS_PER_TASK))
    return rows.repartition(tasks, "symbol")


def bars(spark: SparkSession, sf_dir: str, shares: int = 1) -> DataFrame:
    """Daily bars per supplier from line items; ``shares`` as for ``by_symbol``."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem")
    trades = lines.select(
        F.concat(F.lit("S"), C("l_suppkey")).alias("symbol"),
        F.to_date("l_shipdate").alias("ts"),
        F.round("l_extendedprice").alias("price"),
        C("l_quantity").alias("qty"),
        order.alias("seq"),
    )
    return by_symbol(trades, lines, shares).groupBy("symbol", "ts").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("qty").alias("volume"),
    )


BARS_SQL = """
bars AS (
  SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ts,
         first(round(l_extendedprice) ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
         max(round(l_extendedprice)) AS high, min(round(l_extendedprice)) AS low,
         last(round(l_extendedprice) ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""


def user_bars(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    """Daily bars per group of five users, or hourly bars per user, from events; quiet hours leave gaps."""
    symbol = F.concat(F.lit("U"), F.expr("user_id div 5")) if unit == "day" else F.concat(F.lit("U"), C("user_id"))
    ts = F.to_date("ts") if unit == "day" else F.date_trunc("hour", C("ts"))
    seq = F.struct("ts", "event_id")
    quotes = table(spark, sf_dir, "events").select(
        symbol.alias("symbol"), ts.cast("date" if unit == "day" else "timestamp_ntz").alias("bar_ts"), F.round(C("value") * 100).alias("price"), seq.alias("seq")
    )
    return (
        quotes.groupBy("symbol", "bar_ts")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .withColumnRenamed("bar_ts", "ts")
    )


def _user_bars_sql(name: str, symbol: str, ts: str) -> str:
    return f"""
{name} AS (
  SELECT {symbol} AS symbol, {ts} AS ts,
         first(round(value * 100) ORDER BY e.ts, event_id) AS open, max(round(value * 100)) AS high,
         min(round(value * 100)) AS low, last(round(value * 100) ORDER BY e.ts, event_id) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM events e GROUP BY 1, 2)"""


USER_BARS_SQL = _user_bars_sql("ubars", "'U' || (user_id // 5)", "CAST(e.ts AS DATE)")
HOUR_BARS_SQL = _user_bars_sql("hbars", "'U' || user_id", "date_trunc('hour', e.ts)")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items per group of five users."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.expr("user_id div 5")).alias("symbol"),
        "ts",
        F.round((F.expr("(event_id * 37) % 201") - 100) / 100, 2).alias("sentiment_score"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"),
        C("event_type").alias("source"),
        "event_id",
    )


NEWS_SQL = """
news AS (
  SELECT 'U' || (user_id // 5) AS symbol, ts, round(((event_id * 37) % 201 - 100) / 100.0, 2)::DOUBLE AS sentiment_score,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence, event_type AS source, event_id
  FROM events)"""

SOURCES = ("click", "error", "purchase", "signup", "view")


def macro(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """Monthly (or weekly) averages of three line-item measures, long form; rows are bounded by the calendar."""
    grouped = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.to_date(F.date_trunc(unit, C("l_shipdate"))).alias("date"))
        .agg(F.avg(F.round(C("l_discount") * 100)).alias("DISC"), F.avg(F.round(C("l_tax") * 100)).alias("TAX"), F.avg("l_quantity").alias("QTY"))
    )
    return grouped.unpivot("date", ["DISC", "TAX", "QTY"], "series_id", "value").select("series_id", "date", "value")


def macro_sql(name: str = "macro", unit: str = "month") -> str:
    return f"""
{name} AS (
  SELECT s.series_id, g.date, CASE s.series_id WHEN 'DISC' THEN g.disc WHEN 'TAX' THEN g.tax ELSE g.qty END AS value
  FROM (SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS date, avg(round(l_discount * 100)) AS disc, avg(round(l_tax * 100)) AS tax,
               avg(l_quantity) AS qty FROM lineitem GROUP BY 1) g
  CROSS JOIN (VALUES ('DISC'), ('TAX'), ('QTY')) s(series_id))"""


def book(spark: SparkSession, sf_dir: str, depth: int = 3) -> DataFrame:
    """Order-book snapshots, one per event, keyed by event type (five heavy keys)."""
    levels = []
    for k in range(1, depth + 1):
        levels += [
            (F.round(C("value") * 100) - k).alias(f"bid_price_{k}"),
            (F.expr(f"(event_id * {k}) % 17") + 1).cast("double").alias(f"bid_size_{k}"),
            (F.round(C("value") * 100) + k).alias(f"ask_price_{k}"),
            (F.expr(f"(event_id * {k}) % 13") + 1).cast("double").alias(f"ask_size_{k}"),
        ]
    return table(spark, sf_dir, "events").select(C("event_type").alias("symbol"), "ts", "event_id", *levels)


BOOK_SQL = (
    "\nbook AS (\n  SELECT event_type AS symbol, ts, event_id, "
    + ", ".join(
        f"round(value * 100) - {k} AS bid_price_{k}, CAST((event_id * {k}) % 17 + 1 AS DOUBLE) AS bid_size_{k}, "
        f"round(value * 100) + {k} AS ask_price_{k}, CAST((event_id * {k}) % 13 + 1 AS DOUBLE) AS ask_size_{k}"
        for k in (1, 2, 3)
    )
    + "\n  FROM events)"
)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events as price ticks under five heavy keys."""
    return table(spark, sf_dir, "events").select(
        C("event_type").alias("symbol"),
        "ts",
        "event_id",
        (F.round(C("value") * 100)).alias("close"),
        (F.round(C("value") * 100) + C("event_id") % 5).alias("high"),
        (F.round(C("value") * 100) - C("event_id") % 7).alias("low"),
        (C("event_id") % 11 + 1).cast("double").alias("volume"),
    )


TICKS_SQL = """
ticks AS (
  SELECT event_type AS symbol, ts, event_id, round(value * 100) AS close, round(value * 100) + event_id % 5 AS high,
         round(value * 100) - event_id % 7 AS low, CAST(event_id % 11 + 1 AS DOUBLE) AS volume
  FROM events)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw articles with a nested source; urls repeat."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 30 as int))").alias("publishedAt"),
        F.struct(F.lit(None).cast("string").alias("id"), C("source").alias("name")).alias("source"),
        F.substring("text", 1, 60).alias("title"),
        C("text").alias("description"),
        F.concat(C("source"), F.lit("/"), (C("doc_id") % 150)).alias("url"),
        C("lang"),
        (C("doc_id") % 4).cast("int").alias("query_ix"),
    )


ARTICLES_SQL = """
articles AS (
  SELECT doc_id, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER)) AS publishedAt,
         source AS source_name, substr(text, 1, 60) AS title, text AS description,
         source || '/' || (doc_id % 150) AS url, lang, CAST(doc_id % 4 AS INTEGER) AS query_ix
  FROM documents)"""


def faulty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with faults placed by the row number of the day within its symbol."""
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    b = bars(spark, sf_dir, SORTED_AGAIN).withColumn("rn", rn)
    hit = lambda m: C("rn") % m == 0
    marked = b.select(
        "symbol",
        "ts",
        "open",
        F.when(hit(97), C("low") - 1).otherwise(C("high")).alias("high"),
        "low",
        F.when(hit(101), F.lit(-10.0)).when(hit(107), F.lit(None)).otherwise(C("close")).alias("close"),
        F.when(hit(103), F.lit(-1000.0)).otherwise(C("volume")).alias("volume"),
        "rn",
    )
    copies = F.when(C("rn") % 109 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return marked.withColumn("copy", F.explode(copies))


FAULTY_SQL = """
faulty AS (
  SELECT symbol, ts, open, CASE WHEN rn % 97 = 0 THEN low - 1 ELSE high END AS high, low,
         CASE WHEN rn % 101 = 0 THEN -10.0 WHEN rn % 107 = 0 THEN NULL ELSE close END AS close,
         CASE WHEN rn % 103 = 0 THEN -1000.0 ELSE volume END AS volume, rn, c.copy
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars) b
  JOIN (VALUES (1), (2)) c(copy) ON c.copy = 1 OR rn % 109 = 0)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smooth price level per symbol and day: the rounded mean of the last 20 closes."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-19, 0)
    return bars(spark, sf_dir, SORTED_AGAIN).select("symbol", "ts", F.round(F.avg("close").over(w)).alias("close"))


LEVELS_SQL = (
    BARS_SQL
    + """,
levels AS MATERIALIZED (SELECT symbol, ts, round(avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS close FROM bars)"""
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-day return of the level, and three lag-based guesses at it."""
    w = Window.partitionBy("symbol").orderBy("ts")
    ret = C("close") / F.lag("close").over(w) - 1
    base = levels(spark, sf_dir).withColumn("r", ret)
    mean5 = F.when(F.count("r").over(w.rowsBetween(-4, 0)) == 5, F.avg("r").over(w.rowsBetween(-4, 0)))
    rows = base.withColumns({"actual": F.lead("r").over(w), "mean5": mean5})
    guess = F.array(
        F.struct(F.lit("naive").alias("model"), F.lit(0.0).alias("predicted")),
        F.struct(F.lit("mom1").alias("model"), C("r").alias("predicted")),
        F.struct(F.lit("mean5").alias("model"), C("mean5").alias("predicted")),
    )
    return rows.select("symbol", "ts", "actual", F.inline(guess)).filter(C("actual").isNotNull() & C("predicted").isNotNull())


PREDS_SQL = (
    LEVELS_SQL
    + """,
pr AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM levels),
pn AS (SELECT *, lead(r) OVER w AS actual, CASE WHEN count(r) OVER w5 = 5 THEN avg(r) OVER w5 END AS mean5 FROM pr
  WINDOW w AS (PARTITION BY symbol ORDER BY ts), w5 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
preds AS MATERIALIZED (SELECT * FROM (
  SELECT symbol, ts, actual, 'naive' AS model, 0.0::DOUBLE AS predicted FROM pn UNION ALL SELECT symbol, ts, actual, 'mom1', r FROM pn
  UNION ALL SELECT symbol, ts, actual, 'mean5', mean5 FROM pn) WHERE actual IS NOT NULL AND predicted IS NOT NULL)"""
)
