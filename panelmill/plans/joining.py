"""Macro, as-of and multi-table join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.axis import DAILY, Axis
from ..operators import joins
from ..sources import economic
from . import fixtures as fx
from .catalog import Shape, query
from .sqlkit import wins

C = F.col
BARS, MACRO = fx.BARS_SQL, fx.macro_sql()
SERIES = ("DISC", "TAX", "QTY")


def _asof(series: str, alias: str) -> str:
    return f"ASOF LEFT JOIN (SELECT date, value FROM macro WHERE series_id = '{series}') {alias} ON b.ts >= {alias}.date"


@query(
    "asof_macro",
    Shape(["symbol"], ["ts"], [f"{s}_days_since_update" for s in SERIES], list(SERIES), ["close"]),
    f"""{BARS},{MACRO},
res AS (SELECT b.symbol, b.ts, b.close, {", ".join(f"{s.lower()}_.value AS {s}, CAST(date_diff('day', {s.lower()}_.date, b.ts) AS INTEGER) AS {s}_days_since_update" for s in SERIES)}
  FROM bars b {" ".join(_asof(s, s.lower() + "_") for s in SERIES)})""",
)
def asof_macro(spark, sf):
    return joins.align_macro(fx.bars(spark, sf), fx.macro(spark, sf), SERIES, slow=True)


@query(
    "macro_same_day",
    Shape(["symbol"], ["ts"], [], ["DISC", "TAX"], ["close"]),
    f"""{BARS},{MACRO},
res AS (SELECT b.symbol, b.ts, b.close, d.value AS DISC, t.value AS TAX FROM bars b
  JOIN macro d ON d.series_id = 'DISC' AND d.date = b.ts JOIN macro t ON t.series_id = 'TAX' AND t.date = b.ts)""",
)
def macro_same_day(spark, sf):
    return joins.align_macro(fx.bars(spark, sf), fx.macro(spark, sf), ("DISC", "TAX"), how="inner", slow=False)


@query(
    "macro_auto",
    Shape(["symbol"], ["ts"], ["DISC_days_since_update"], ["DISC", "QTY"], ["close"]),
    f"""{BARS},{MACRO},{fx.macro_sql("daily", "day")},
res AS (SELECT b.symbol, b.ts, b.close, m.value AS DISC, CAST(date_diff('day', m.date, b.ts) AS INTEGER) AS DISC_days_since_update, d.value AS QTY
  FROM bars b ASOF LEFT JOIN (SELECT date, value FROM macro WHERE series_id = 'DISC') m ON b.ts >= m.date LEFT JOIN daily d ON d.series_id = 'QTY' AND d.date = b.ts)""",
)
def macro_auto(spark, sf):
    """A monthly and a daily series, each matched as its number of rows asks for."""
    both = fx.macro(spark, sf).filter(C("series_id") == "DISC").unionByName(fx.macro(spark, sf, "day").filter(C("series_id") == "QTY"))
    return joins.align_macro(fx.bars(spark, sf), both, ("DISC", "QTY"))


@query(
    "macro_outer_fill",
    Shape(["symbol"], ["ts"], [], ["TAX"], ["close"]),
    f"""{BARS},{MACRO},
j AS (SELECT b.symbol, coalesce(b.ts, m.date) AS ts, b.close, m.value AS TAX FROM bars b FULL JOIN (SELECT * FROM macro WHERE series_id = 'TAX') m ON m.date = b.ts),
res AS (SELECT symbol, ts, last_value(close IGNORE NULLS) OVER cum AS close, last_value(TAX IGNORE NULLS) OVER cum AS TAX FROM j {wins()})""",
)
def macro_outer_fill(spark, sf):
    return joins.align_macro(fx.bars(spark, sf), fx.macro(spark, sf), ("TAX",), how="outer", slow=False, fill="ffill")


@query(
    "asof_quotes",
    Shape(["symbol"], [], ["event_id"], ["last_score"], [], ["seen_at"]),
    f"""{fx.NEWS_SQL}, hb AS (SELECT symbol, event_id, ts FROM news WHERE source IN ('click', 'view')),
ob AS (SELECT symbol, ts, min(sentiment_score) AS s FROM news WHERE source NOT IN ('click', 'view') GROUP BY 1, 2),
res AS (SELECT h.symbol, h.event_id, o.s AS last_score, o.ts AS seen_at FROM hb h ASOF LEFT JOIN ob o ON h.symbol = o.symbol AND h.ts >= o.ts)""",
)
def asof_quotes(spark, sf):
    """As-of join of two event streams per symbol, on blocks because a symbol's stream is unbounded."""
    n = fx.news(spark, sf)
    fast = C("source").isin("click", "view")
    left = n.filter(fast).select("symbol", "ts", "event_id")
    right = n.filter(~fast).groupBy("symbol", "ts").agg(F.min("sentiment_score").alias("last_score"))
    return joins.asof_join(left, right, ["last_score"], Axis(tie=("event_id",)), observed="seen_at", blocked=True)


@query(
    "macro_wide",
    Shape([], ["date"], [], list(SERIES)),
    f"""{MACRO},
p AS (SELECT date, {", ".join(f"max(value) FILTER (WHERE series_id = '{s}') AS {s}" for s in SERIES)} FROM macro GROUP BY 1),
res AS (SELECT date, {", ".join(f"last_value({s} IGNORE NULLS) OVER (ORDER BY date) AS {s}" for s in SERIES)} FROM p)""",
)
def macro_wide(spark, sf):
    return economic.macro_wide(fx.macro(spark, sf), SERIES)


@query(
    "macro_mixed_wide",
    Shape([], ["date"], [], ["DISC", "W_TAX"]),
    f"""{MACRO},{fx.macro_sql("weekly", "week")},
d AS (SELECT date, value AS DISC FROM macro WHERE series_id = 'DISC'), t AS (SELECT date, value AS W_TAX FROM weekly WHERE series_id = 'TAX'),
j AS (SELECT coalesce(d.date, t.date) AS date, DISC, W_TAX FROM d FULL JOIN t ON d.date = t.date),
res AS (SELECT date, last_value(DISC IGNORE NULLS) OVER (ORDER BY date) AS DISC, last_value(W_TAX IGNORE NULLS) OVER (ORDER BY date) AS W_TAX FROM j)""",
)
def macro_mixed_wide(spark, sf):
    """Outer alignment of a monthly and a weekly series."""
    weekly = fx.macro(spark, sf, "week").filter(C("series_id") == "TAX").withColumn("series_id", F.lit("W_TAX"))
    return economic.macro_wide(fx.macro(spark, sf).filter(C("series_id") == "DISC").unionByName(weekly), ("DISC", "W_TAX"))


@query(
    "outer_concat",
    Shape(["symbol"], ["ts"], [], [], ["close", "n_items", "qty"]),
    f"""{BARS},
a AS (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ts, CAST(count(*) AS DOUBLE) AS n_items FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
q AS (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) + 1 AS ts, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
res AS (SELECT symbol, ts, close, n_items, qty FROM (SELECT symbol, ts, close FROM bars) b FULL JOIN a USING (symbol, ts) FULL JOIN q USING (symbol, ts))""",
)
def outer_concat(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    key = [F.concat(F.lit("S"), "l_suppkey").alias("symbol")]
    a = li.filter(C("l_returnflag") == "A").groupBy(*key, F.to_date("l_shipdate").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("n_items"))
    q = li.filter(C("l_returnflag") == "R").groupBy(*key, F.date_add(F.to_date("l_shipdate"), 1).alias("ts")).agg(F.sum("l_quantity").alias("qty"))
    return joins.align_frames([fx.bars(spark, sf).select("symbol", "ts", "close"), a, q])


@query(
    "combine_first",
    Shape(["symbol"], ["ts"], [], [], ["close", "volume"]),
    f"""{BARS},
l AS (SELECT symbol, ts, CASE WHEN volume > 30 THEN close END AS close FROM bars WHERE year(ts) < 1999),
r AS (SELECT symbol, ts, close + 1 AS close, volume FROM bars WHERE year(ts) >= 1998),
res AS (SELECT symbol, ts, coalesce(l.close, r.close) AS close, r.volume FROM l FULL JOIN r USING (symbol, ts))""",
)
def combine_first(spark, sf):
    b = fx.bars(spark, sf)
    left = b.filter(F.year("ts") < 1999).select("symbol", "ts", F.when(C("volume") > 30, C("close")).alias("close"))
    right = b.filter(F.year("ts") >= 1998).select("symbol", "ts", (C("close") + 1).alias("close"), "volume")
    return joins.combine_first(left, right, ["symbol", "ts"])


@query(
    "market_neutral",
    Shape(["symbol"], ["ts"], [], ["ret", "neutral"]),
    f"""{BARS},
r AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS ret FROM bars {wins()}),
res AS (SELECT *, ret - avg(ret) OVER (PARTITION BY ts) AS neutral FROM r)""",
)
def market_neutral(spark, sf):
    return joins.market_neutral(fx.bars(spark, sf).select("symbol", "ts", DAILY.pct("close").alias("ret")), "ret")


@query(
    "recession_runs",
    Shape([], ["start", "end"], ["duration_days"]),
    f"""{MACRO},
f AS (SELECT date, CASE WHEN value > (SELECT avg(value) FROM macro WHERE series_id = 'DISC') THEN 1 ELSE 0 END AS flag FROM macro WHERE series_id = 'DISC'),
g AS (SELECT *, sum(CASE WHEN flag = 1 AND coalesce(pf, 0) <> 1 THEN 1 ELSE 0 END) OVER (ORDER BY date) AS run
  FROM (SELECT *, lag(flag) OVER (ORDER BY date) AS pf FROM f)),
s AS (SELECT run, min(date) AS start, max(date) AS last FROM g WHERE flag = 1 GROUP BY 1),
res AS (SELECT start, (SELECT min(date) FROM f WHERE f.flag = 0 AND f.date > s.start) AS "end",
  CAST(date_diff('day', start, (SELECT min(date) FROM f WHERE f.flag = 0 AND f.date > s.start)) AS INTEGER) AS duration_days
  FROM s WHERE EXISTS (SELECT 1 FROM f WHERE f.flag = 0 AND f.date > s.start))""",
)
def recession_runs(spark, sf):
    disc = fx.macro(spark, sf).filter(C("series_id") == "DISC")
    mean = disc.agg(F.avg("value")).first()[0]
    return economic.recession_runs(disc.select("date", (C("value") > mean).cast("int").alias("flag")))


_ids = "['DGS1MO', 'DGS3MO', 'DGS6MO', 'DGS1', 'DGS2', 'DGS3', 'DGS5']"


@query(
    "yield_curve",
    Shape(["series_id"], ["date"], [], ["yield", "maturity_years"]),
    f"""y AS (SELECT ({_ids})[l_linenumber] AS series_id, CAST(l_shipdate AS DATE) AS date, avg(round(l_tax * 100)) AS v FROM lineitem GROUP BY 1, 2),
k AS (SELECT series_id, max_by(v, date) AS yield, max(date) AS date FROM y WHERE date <= DATE '1999-12-31' GROUP BY 1),
res AS (SELECT series_id, date, yield, ([1, 3, 6, 12, 24, 36, 60])[list_position({_ids}, series_id)] / 12.0 AS maturity_years FROM k)""",
)
def yield_curve(spark, sf):
    ids = F.array(*[F.lit(x) for x in ("DGS1MO", "DGS3MO", "DGS6MO", "DGS1", "DGS2", "DGS3", "DGS5")])
    macro = (
        fx.table(spark, sf, "lineitem")
        .groupBy(F.element_at(ids, C("l_linenumber")).alias("series_id"), F.to_date("l_shipdate").alias("date"))
        .agg(F.avg(F.round(C("l_tax") * 100)).alias("value"))
    )
    return economic.yield_curve(macro, "1999-12-31")


def _corr(x: str, y: str, n: int) -> str:
    return f"""CASE WHEN count(*) OVER w{n} = {n} AND min({x}) OVER w{n} <> max({x}) OVER w{n} AND min({y}) OVER w{n} <> max({y}) OVER w{n}
      THEN corr({x}, {y}) OVER w{n} END"""


@query(
    "rolling_corr",
    Shape(["symbol"], [], ["observations"], ["correlation", "rolling_mean", "rolling_std"]),
    f"""{BARS},
r AS (SELECT *, {_corr("close", "volume", 252)} AS rc FROM bars {wins(252)}),
res AS (SELECT symbol, corr(close, volume) AS correlation, avg(rc) AS rolling_mean, stddev_samp(rc) AS rolling_std, count(*) AS observations FROM r GROUP BY 1)""",
)
def rolling_corr(spark, sf):
    return economic.indicator_correlation(fx.bars(spark, sf), "close", "volume", DAILY)


@query(
    "parse_observations",
    Shape(["series_id"], ["date"], [], ["value"]),
    f"""{fx.macro_sql("macro", "week")},
res AS (SELECT series_id, date, CAST(round(value, 4) AS DOUBLE) AS value FROM macro WHERE day(date) > 7)""",
)
def parse_observations(spark, sf):
    """JSON payloads of weekly observations; the first week of a month is published as '.'."""
    m = fx.macro(spark, sf, "week")
    shown = F.when(F.dayofmonth("date") > 7, F.round("value", 4).cast("string")).otherwise(".")
    obs = F.struct(C("date").cast("string").alias("date"), shown.alias("value"))
    payload = F.to_json(F.struct(F.collect_list(obs).alias("observations")))
    return economic.parse_observations(m.groupBy("series_id", F.year("date").alias("y")).agg(payload.alias("payload")))


@query(
    "search_series",
    Shape([], [], ["series_id", "title"]),
    "res AS (SELECT p_partkey AS series_id, p_name AS title FROM part WHERE lower(p_name) LIKE '%ring%' ORDER BY p_partkey LIMIT 10)",
)
def search_series(spark, sf):
    catalogue = fx.table(spark, sf, "part").select(C("p_partkey").alias("series_id"), C("p_name").alias("title"))
    return economic.search_series(catalogue, "RING")
