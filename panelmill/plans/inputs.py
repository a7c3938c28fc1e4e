"""Readers, writers, lookups and small operators over the driver tables: what is written by a sink is read back by a source."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.axis import DAILY
from ..functions.rolling import rolling_apply
from ..operators import joins, ml
from ..operators import forecast as fc
from ..operators import quality_history as qh
from ..operators import validation as val
from ..session import scratch, settle, written
from ..sources import economic, market, orderbook, sinks
from . import fixtures as fx
from .catalog import REGISTRY, Shape, query
from .quality import NOW
from .sqlkit import full, wins

C = F.col
BARS = fx.BARS_SQL
_FROM, _TO = "1996-01-10", "1998-06-30"


@query(
    "bars_from_csv",
    Shape(["symbol"], ["ts"], [], ["volume"], ["open", "high", "low", "close"]),
    f"{BARS}, res AS (SELECT * FROM bars WHERE symbol IN ('S1', 'S3', 'S5', 'S8') AND ts BETWEEN DATE '{_FROM}' AND DATE '{_TO}')",
)
def bars_from_csv(spark, sf):
    """Four symbols in one read of two folders of CSV files, cut to a range of dates."""
    bars = fx.bars(spark, sf).select("symbol", C("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")
    odd = F.substring("symbol", 2, 9).cast("int") % 2 == 1
    paths = [scratch(spark, "csv") for _ in range(2)]
    for path, rows in zip(paths, (bars.filter(odd), bars.filter(~odd)), strict=True):
        sinks.write_table(rows, path, "csv")
    return market.read_bars(spark, paths, ["S1", "S3", "S5", "S8"], _FROM, _TO, fmt="csv")


@query(
    "indicator_lookup",
    Shape(["series_id"], [], ["names"]),
    """c AS (SELECT c_custkey % 5 AS k, c_name FROM customer),
res AS (SELECT CASE k WHEN 4 THEN c_name ELSE NULL END AS series_id, count(*) AS names FROM c WHERE k = 4 GROUP BY 1
  UNION ALL SELECT CASE k WHEN 0 THEN 'DFF' WHEN 1 THEN 'DGS10' WHEN 2 THEN 'GDPC1' ELSE 'Unknown Thing' END, count(*) FROM c WHERE k < 4 GROUP BY 1)""",
)
def indicator_lookup(spark, sf):
    """Customers named after indicators in any case; the fifth of them by their own names, which are taken as codes."""
    titles = {code: economic.INDICATORS[code] for code in ("DFF", "DGS10", "GDPC1")}
    known = [titles["DFF"].upper(), titles["DGS10"].lower(), titles["GDPC1"], "Unknown Thing"]
    pick = F.element_at(F.array(*map(F.lit, known)), (C("c_custkey") % 5 + 1).cast("int"))
    names = fx.table(spark, sf, "customer").select(F.when(C("c_custkey") % 5 == 4, C("c_name")).otherwise(pick).alias("name"))
    return economic.resolve_indicator(names).groupBy("series_id").agg(F.count(F.lit(1)).alias("names"))


@query(
    "series_info",
    Shape(["series_id"], [], ["title"], ["price"]),
    "res AS (SELECT p_partkey AS series_id, p_name AS title, p_retailprice AS price FROM part WHERE p_partkey = 17)",
)
def series_info(spark, sf):
    catalogue = fx.table(spark, sf, "part").select(C("p_partkey").alias("series_id"), C("p_name").alias("title"), C("p_retailprice").alias("price"))
    return economic.series_info(catalogue, 17)


@query(
    "book_from_csv",
    Shape(["symbol"], [], ["event_rows"], [], ["bid_price", "ask_size", "bid_price_2", "ask_price_2"], times=["ts"]),
    f"""{fx.BOOK_SQL},
res AS (SELECT symbol, date_trunc('hour', ts + INTERVAL 9 HOUR) AS ts, count(*) AS event_rows, avg(bid_price_1) AS bid_price, avg(ask_size_1) AS ask_size,
  avg(bid_price_2) AS bid_price_2, avg(ask_price_2) AS ask_price_2 FROM book GROUP BY 1, 2)""",
)
def book_from_csv(spark, sf):
    """Snapshots of three levels as CSV, two of them read back in another time zone, as hourly means."""
    path = scratch(spark, "book")
    book = fx.book(spark, sf).withColumn("timestamp", C("ts").cast("timestamp")).drop("ts", "event_id")
    sinks.write_table(book.select(*[C(c).alias(c.upper() if c != "symbol" else c) for c in book.columns]), path, "csv")
    levels = orderbook.load_orderbook_csv(spark, path, depth=2, tz="Asia/Tokyo")
    mean = [F.avg(c).alias(c) for c in ("bid_price", "ask_size", "bid_price_2", "ask_price_2")]
    return levels.groupBy("symbol", F.date_trunc("hour", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("event_rows"), *mean)


@query(
    "quality_history",
    Shape(["category"], [], ["runs", "total_datasets", "total_issues"], ["avg_quality_score"]),
    f"""{REGISTRY["quality_report"].body().replace("res AS (", "r9 AS (")}, one AS (SELECT count(*) AS k, sum(total_issues) AS i, avg(quality_score) AS q FROM reports),
res AS (SELECT c AS category, 2 AS runs, 2 * k AS total_datasets, (2 * i)::BIGINT AS total_issues, q AS avg_quality_score FROM one, (VALUES ('market'), ('again')) t(c))""",
)
def quality_history(spark, sf):
    """Two runs in two categories, appended to a history one after the other and read back."""
    path = scratch(spark, "history")
    reports = settle(val.validate_market(fx.faulty_bars(spark, sf).drop("rn", "copy"), now=NOW)[1])
    for day in ("2024-01-01", "2024-01-02"):
        for category in ("market", "again"):
            sinks.append_history(qh.run_summary(reports, F.lit(day).cast("date"), F.lit(category)), path)
    runs = sinks.read_history(spark, path)
    return runs.groupBy("category").agg(
        F.count(F.lit(1)).cast("int").alias("runs"), F.sum("total_datasets").alias("total_datasets"), F.sum("total_issues").alias("total_issues"), F.avg("avg_quality_score").alias("avg_quality_score")
    )


@query(
    "truth_overlap",
    Shape(["symbol"], ["ts"], [], [], ["close", "predicted"]),
    f"""{BARS}, res AS (SELECT a.symbol, a.ts, a.close, b.close + 1 AS predicted FROM bars a JOIN bars b ON b.symbol = a.symbol AND b.ts = a.ts WHERE month(a.ts) <= 9 AND month(a.ts) >= 3)""",
)
def truth_overlap(spark, sf):
    """Times that truth (to September) and prediction (from March) have in common."""
    bars = written(fx.bars(spark, sf))
    return joins.overlap(bars.filter(F.month("ts") <= 9).select("symbol", "ts", "close"), bars.filter(F.month("ts") >= 3).select("symbol", "ts", (C("close") + 1).alias("predicted")))


@query(
    "missing_features",
    Shape(["symbol"], ["ts"], [], ["volume", "SMA_9", "mood"], ["close"]),
    f"{BARS}, res AS (SELECT symbol, ts, close, volume, 0.0 AS SMA_9, 0.0 AS mood FROM bars)",
)
def missing_features(spark, sf):
    """Two of four features a model was fitted with are not in the data."""
    return ml.with_missing_features(fx.bars(spark, sf), ["close", "volume", "SMA_9", "mood"])


@query(
    "column_rules",
    Shape(["symbol"], [], ["severity", "category", "column"]),
    f"""{BARS}, d AS (SELECT DISTINCT symbol FROM bars), n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1),
res AS (SELECT symbol, 'ERROR' AS severity, 'columns' AS category, NULL::VARCHAR AS "column" FROM d UNION ALL SELECT symbol, 'WARNING', 'columns', NULL FROM d
  UNION ALL SELECT symbol, 'ERROR', 'data_types', 'volume' FROM d UNION ALL SELECT symbol, 'INFO', 'data_types', 'volume' FROM d UNION ALL SELECT symbol, 'ERROR', 'data_types', 'high' FROM d)""",
)
def column_rules(spark, sf):
    """A required column is gone, one has a suspicious name, volume is text that looks numeric, high is text that does not."""
    bars = fx.bars(spark, sf).drop("open").withColumns({"volume": C("volume").cast("string"), "high": F.lit("n/a"), "untitled": F.lit(1.5)})
    issues = val.validate_market(bars, now=NOW)[0]
    return issues.filter(C("category").isin("columns", "data_types")).select("symbol", "severity", "category", "column")


@query("update_forecast", Shape(["symbol"], ["ts"], ["step"], [], [], [], ["predicted"]), REGISTRY["theta_forecast"].body())
def update_forecast(spark, sf):
    """History up to 1999 and what came after it give the forecast of the whole."""
    levels = written(fx.levels(spark, sf))
    cut = F.lit("1999-01-01").cast("date")
    return fc.update_forecast(levels.filter(C("ts") < cut), levels.filter(C("ts") >= cut), models=["theta"])


@query(
    "rolling_range",
    Shape(["symbol"], ["ts"], [], [], ["range_20"]),
    f"{BARS}, res AS (SELECT symbol, ts, {full(20, 'close', 'max(close) OVER w20 - min(close) OVER w20')} AS range_20 FROM bars {wins(20)})",
)
def rolling_range(spark, sf):
    """A statistic of the user's own over the last 20 rows."""
    frame, call = rolling_apply("close", DAILY, 20, np.ptp)
    return fx.bars(spark, sf).withColumn("_f", frame).withColumn("range_20", call(C("_f")))


@query(
    "impute",
    Shape(["symbol"], ["ts"], [], ["mood"], ["close"]),
    f"""{BARS},{fx.FAULTY_SQL},
one AS (SELECT symbol, ts, min(close) AS close, CASE WHEN rn > 40 THEN rn % 7 END AS mood FROM (SELECT symbol, ts, close, rn FROM faulty) GROUP BY symbol, ts, rn),
fl AS (SELECT symbol, ts, coalesce(last_value(close IGNORE NULLS) OVER cum, first_value(close IGNORE NULLS) OVER rest) AS close,
  coalesce(last_value(mood IGNORE NULLS) OVER cum, first_value(mood IGNORE NULLS) OVER rest)::DOUBLE AS mood FROM one
  {wins(extra=", rest AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")}),
res AS (SELECT * FROM fl WHERE close IS NOT NULL AND mood IS NOT NULL)""",
)
def impute(spark, sf):
    """Gaps filled forward, then backward, then by the series' median; what is still incomplete goes."""
    rows = fx.faulty_bars(spark, sf).groupBy("symbol", "ts", "rn").agg(F.min("close").alias("close"))
    rows = rows.select("symbol", "ts", "close", F.when(C("rn") > 40, C("rn") % 7).cast("double").alias("mood"))
    return ml.impute(rows, ["close", "mood"])


@query(
    "stored_model",
    Shape(["feature"], [], ["same"], ["importance"]),
    f"""{fx.LEVELS_SQL}, xy AS MATERIALIZED (SELECT * FROM (SELECT close / 1000 AS y, lag(close) OVER w / 1000 AS x FROM levels {wins()}) WHERE x IS NOT NULL),
res AS (SELECT 'x' AS feature, abs((SELECT regr_slope(y, x) FROM xy)) AS importance, TRUE AS same)""",
)
def stored_model(spark, sf):
    """A model written and loaded again: its coefficient, and whether both predict the same."""
    levels = fx.levels(spark, sf)
    data = settle(levels.select("symbol", "ts", (C("close") / 1000).alias("target"), (DAILY.lag("close") / 1000).alias("x")).filter(C("x").isNotNull()))
    model = ml.build("linear", data, ["x"])
    path = scratch(spark, "model")
    ml.save_model(model, path)
    again = ml.load_model(path)
    both = ml.predict(again, ml.predict(model, data, "a"), "b")
    same = both.agg(F.coalesce(F.bool_and(C("a") == C("b")), F.lit(False)).alias("same"))
    rows = [(f, v) for f, v in ml.feature_importance(again, ["x"])]
    return spark.createDataFrame(rows, "feature string, importance double").join(F.broadcast(same.withColumn("_one", F.lit(1))), F.lit(1) == C("_one"))


_EDGE = lambda c: f"coalesce({c}, first_value({c} IGNORE NULLS) OVER rest) AS {c}"


@query(
    "deep_frame",
    Shape(["symbol"], ["ts"], [], ["micro_spread_pct", "micro_mid_return", "ROC_5"], ["close", "micro_mid_price", "SMA_5"]),
    f"""{BARS},
q AS (SELECT symbol, ts, close, close AS micro_mid_price, 2 / close AS micro_spread_pct, ln(close) - ln(lag(close) OVER w) AS micro_mid_return, avg(close) OVER w5 AS SMA_5,
  (close - lag(close, 5) OVER w) / lag(close, 5) OVER w * 100 AS ROC_5 FROM bars {wins(5)}),
res AS (SELECT symbol, ts, close, micro_mid_price, micro_spread_pct, SMA_5, {_EDGE("micro_mid_return")}, {_EDGE("ROC_5")} FROM q
  {wins(extra=", rest AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")})""",
)
def deep_frame(spark, sf):
    """All indicators and quote features without gaps, as a network takes them."""
    bars = fx.bars(spark, sf)
    return ml.deep_frame(bars.withColumns({"bid_price": C("close") - 1, "ask_price": C("close") + 1}))
