"""Data-quality queries: rules, reports, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality_history as hist
from ..operators import validation as val
from ..session import settle
from . import fixtures as fx
from .catalog import Shape, query
from .sqlkit import wins

C = F.col
NOW = "2030-01-01 00:00:00"
_COLS = ("open", "high", "low", "close", "volume")


def _market_issues_sql(source: str) -> str:
    """Issue rows of the market rules over ``source`` (symbol, ts, ohlcv)."""
    pick = lambda cond, sev, cat, column, k, pct="NULL::DOUBLE": (
        f"SELECT symbol, {sev} AS severity, '{cat}' AS category, {column} AS col, {k} AS row_count, {pct} AS percentage FROM agg WHERE {cond}"
    )
    q = lambda s: f"'{s}'"
    none = "NULL::VARCHAR"
    parts = [
        pick("n < 10", q("WARNING"), "structure", none, "n"),
        pick("TRUE", q("INFO"), "index", q("ts"), "NULL::BIGINT"),
        *[pick(f"neg_{c} > 0", q("ERROR"), "value_ranges", q(c), f"neg_{c}", f"neg_{c} / n * 100") for c in _COLS],
        *[pick(f"null_{c} / n * 100 > 10", f"CASE WHEN null_{c} / n * 100 > 50 THEN 'ERROR' ELSE 'WARNING' END", "missing_data", q(c), f"null_{c}", f"null_{c} / n * 100") for c in _COLS],
        pick("hv > 0", q("ERROR"), "business_logic", none, "hv"),
        pick("lv > 0", q("ERROR"), "business_logic", none, "lv"),
        pick("neg_volume > 0", q("ERROR"), "business_logic", q("volume"), "neg_volume"),
        *[pick(f"np_{c} > 0", q("ERROR"), "business_logic", q(c), f"np_{c}") for c in _COLS[:4]],
        pick("we > 0", q("INFO"), "time_series", none, "we"),
        "SELECT symbol, 'WARNING', 'duplicates', NULL, k, k / n * 100 FROM (SELECT symbol, sum(c - 1)::BIGINT AS k FROM (SELECT symbol, open, high, low, close, volume, count(*) AS c FROM src GROUP BY ALL) GROUP BY 1) JOIN agg USING (symbol) WHERE k > 0",
        "SELECT symbol, 'ERROR', 'index', 'ts', k, NULL FROM (SELECT symbol, sum(c - 1)::BIGINT AS k FROM (SELECT symbol, ts, count(*) AS c FROM src GROUP BY ALL) GROUP BY 1) WHERE k > 0",
        "SELECT symbol, 'WARNING', 'time_series', NULL, gap_count, NULL FROM gaps WHERE gap_count > 0",
        """SELECT symbol, CASE WHEN k / known * 100 > 25 THEN 'ERROR' WHEN k / known * 100 > 10 THEN 'WARNING' ELSE 'INFO' END, 'outliers', col, k, k / known * 100
           FROM outl WHERE known > 10 AND iqr > 0 AND k > 0""",
    ]
    long = " UNION ALL ".join(f"SELECT symbol, '{c}' AS col, {c} AS v FROM src WHERE {c} IS NOT NULL" for c in _COLS)
    return f"""src AS (SELECT symbol, ts, open, high, low, close, volume FROM {source}),
agg AS (SELECT symbol, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {c} < 0) AS neg_{c}, count(*) FILTER (WHERE {c} <= 0) AS np_{c}, count(*) - count({c}) AS null_{c}" for c in _COLS)},
  count(*) FILTER (WHERE high < greatest(open, close)) AS hv, count(*) FILTER (WHERE low > least(open, close)) AS lv, count(*) FILTER (WHERE isodow(ts) > 5) AS we FROM src GROUP BY 1),
st AS (SELECT symbol, date_diff('day', lag(ts) OVER w, ts) AS step FROM src {wins()}),
sc AS (SELECT symbol, step, count(*) AS k FROM st WHERE step IS NOT NULL GROUP BY 1, 2),
ex AS (SELECT *, first_value(step) OVER (PARTITION BY symbol ORDER BY k DESC, step) AS expected FROM sc),
gaps AS (SELECT symbol, max(expected) AS expected, coalesce(sum(k) FILTER (WHERE step > expected * 1.5), 0)::BIGINT AS gap_count FROM ex GROUP BY 1),
long AS ({long}),
qs AS (SELECT symbol, col, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM long GROUP BY 1, 2),
outl AS (SELECT symbol, col, count(*) AS known, max(q3 - q1) AS iqr, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS k
  FROM long JOIN qs USING (symbol, col) GROUP BY 1, 2),
issues AS ({" UNION ALL ".join(parts)})"""


_REPORT = f"""
miss AS (SELECT symbol, n, ({" + ".join(f"null_{c}" for c in _COLS)}) / (n * 5.0) * 100 AS missing_pct FROM agg),
rep AS (SELECT m.symbol, any_value(m.n) AS rows, any_value(m.missing_pct) AS missing_pct,
  {", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}_issues" for s in ("CRITICAL", "ERROR", "WARNING", "INFO"))}, count(severity) AS total_issues
  FROM miss m LEFT JOIN issues i USING (symbol) GROUP BY 1),
reports AS (SELECT *, greatest(0, 100 - 25 * critical_issues - 10 * error_issues - 5 * warning_issues - info_issues - 0.5 * missing_pct) AS quality_score,
  critical_issues = 0 AS is_valid, critical_issues = 0 AND warning_issues = 0 AS is_valid_strict FROM rep)"""
_FAULTY = f"{fx.BARS_SQL},{fx.FAULTY_SQL}, {_market_issues_sql('faulty')}"


def _checked(spark, sf):
    return val.validate_market(fx.faulty_bars(spark, sf).drop("rn", "copy"), now=NOW)


@query(
    "quality_issues",
    Shape(["symbol"], [], ["severity", "category", "column", "row_count"], ["percentage"]),
    f'{_FAULTY}, res AS (SELECT symbol, severity, category, col AS "column", row_count, percentage FROM issues)',
)
def quality_issues(spark, sf):
    return _checked(spark, sf)[0]


@query(
    "quality_report",
    Shape(
        ["symbol"], [], ["rows", "critical_issues", "error_issues", "warning_issues", "info_issues", "total_issues", "is_valid", "is_valid_strict"],
        ["missing_pct", "quality_score"],
    ),
    f"{_FAULTY},{_REPORT}, res AS (SELECT * FROM reports)",
)
def quality_report(spark, sf):
    return _checked(spark, sf)[1]


@query(
    "validation_summary",
    Shape([], [], ["reports", "with_critical"], ["average_score"]),
    f"{_FAULTY},{_REPORT}, res AS (SELECT count(*) AS reports, count(*) FILTER (WHERE critical_issues > 0) AS with_critical, avg(quality_score) AS average_score FROM reports)",
)
def validation_summary(spark, sf):
    return val.validation_summary(_checked(spark, sf)[1])


@query(
    "iqr_outliers",
    Shape(["symbol"], [], ["column", "known", "outliers"], [], ["iqr"]),
    f'{_FAULTY}, res AS (SELECT symbol, col AS "column", known, k AS outliers, iqr FROM outl)',
)
def iqr_outliers(spark, sf):
    return val.outlier_counts(fx.faulty_bars(spark, sf), _COLS)


@query(
    "iqr_outliers_heavy",
    Shape(["symbol"], [], ["column", "known", "outliers"], [], ["iqr"]),
    f"""{fx.TICKS_SQL},
q AS (SELECT symbol, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3 FROM ticks GROUP BY 1),
res AS (SELECT symbol, 'close' AS "column", count(*) AS known, max(q3 - q1) AS iqr,
  count(*) FILTER (WHERE close < q1 - 1.5 * (q3 - q1) OR close > q3 + 1.5 * (q3 - q1)) AS outliers FROM ticks JOIN q USING (symbol) GROUP BY 1)""",
)
def iqr_outliers_heavy(spark, sf):
    return val.outlier_counts(fx.ticks(spark, sf), ["close"], heavy=True)


@query(
    "time_gaps",
    Shape(["symbol"], [], ["gap_count"], ["expected_step"]),
    f"{_FAULTY}, res AS (SELECT symbol, gap_count, expected * 86400.0 AS expected_step FROM gaps)",
)
def time_gaps(spark, sf):
    return val.time_gaps(fx.faulty_bars(spark, sf))


def _outliers_sql(source: str, *columns: str) -> str:
    """Rows of the outlier rule over one dataset: level, column, rows, percentage."""
    one = lambda c: f"""SELECT CASE WHEN k / known * 100 > 25 THEN 'ERROR' WHEN k / known * 100 > 10 THEN 'WARNING' ELSE 'INFO' END AS severity, 'outliers' AS category, '{c}' AS "column",
    k AS row_count, k / known * 100 AS percentage FROM (SELECT count({c}) AS known, any_value(q3 - q1) AS iqr, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS k
    FROM {source}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source})) WHERE known > 10 AND iqr > 0 AND k > 0"""
    return " UNION ALL ".join(one(c) for c in columns)


@query(
    "sentiment_quality",
    Shape([], [], ["severity", "category", "column", "row_count"], ["percentage"]),
    f"""{fx.NEWS_SQL},
s AS (SELECT ts, sentiment_score * CASE WHEN event_id % 50 = 0 THEN 3 ELSE 1 END AS sentiment_score, CASE WHEN event_id % 4 = 0 THEN NULL ELSE confidence * 1.2 END AS confidence FROM news),
a AS (SELECT count(*) AS n, count(*) FILTER (WHERE sentiment_score < -1) AS slo, count(*) FILTER (WHERE sentiment_score > 1) AS shi, count(*) FILTER (WHERE confidence > 1) AS chi,
  count(*) - count(confidence) AS cn, count(*) - count(DISTINCT ts) AS dts FROM s),
dr AS (SELECT sum(c - 1)::BIGINT AS k FROM (SELECT count(*) AS c FROM s GROUP BY sentiment_score, confidence)),
res AS (SELECT * FROM (
  SELECT 'INFO' AS severity, 'index' AS category, 'ts' AS "column", NULL::BIGINT AS row_count, NULL::DOUBLE AS percentage FROM a
  UNION ALL SELECT 'ERROR', 'value_ranges', 'sentiment_score', slo, slo / n * 100 FROM a WHERE slo > 0
  UNION ALL SELECT 'ERROR', 'value_ranges', 'sentiment_score', shi, shi / n * 100 FROM a WHERE shi > 0
  UNION ALL SELECT 'ERROR', 'value_ranges', 'confidence', chi, chi / n * 100 FROM a WHERE chi > 0
  UNION ALL SELECT 'WARNING', 'missing_data', 'confidence', cn, cn / n * 100 FROM a WHERE cn / n > 0.1
  UNION ALL SELECT 'ERROR', 'business_logic', 'sentiment_score', slo + shi, NULL FROM a WHERE slo + shi > 0
  UNION ALL SELECT 'ERROR', 'business_logic', 'confidence', chi, NULL FROM a WHERE chi > 0
  UNION ALL SELECT 'WARNING', 'duplicates', NULL, k, k / n * 100 FROM dr, a WHERE k > 0
  UNION ALL SELECT 'ERROR', 'index', 'ts', dts, NULL FROM a WHERE dts > 0
  UNION ALL {_outliers_sql("s", "sentiment_score", "confidence")}) u)""",
)
def sentiment_quality(spark, sf):
    """One dataset for the whole table, with the distributed (heavy) forms of order-dependent rules."""
    n = fx.news(spark, sf)
    shifted = n.select(
        "ts",
        (C("sentiment_score") * F.when(C("event_id") % 50 == 0, 3).otherwise(1)).alias("sentiment_score"),
        F.when(C("event_id") % 4 == 0, None).otherwise(C("confidence") * 1.2).alias("confidence"),
    )
    return val.validate_sentiment(shifted, by=(), now=NOW, heavy=True)[0]


@query(
    "economic_quality",
    Shape([], [], ["severity", "category", "column", "row_count"], ["percentage"]),
    f"""{fx.macro_sql()},
w AS (SELECT date, max(value) FILTER (WHERE series_id = 'QTY') * 2 AS DFF, max(value) FILTER (WHERE series_id = 'TAX') - 4 AS DGS10 FROM macro GROUP BY 1),
a AS (SELECT count(*) AS n, count(*) FILTER (WHERE DFF > 50) AS hi, count(*) FILTER (WHERE DGS10 < 0) AS lo, count(*) FILTER (WHERE DFF > 50 OR DFF < 0) AS r1,
  count(*) FILTER (WHERE DGS10 > 50 OR DGS10 < 0) AS r2, count(*) FILTER (WHERE DFF IS NULL AND DGS10 IS NULL) AS bare, count(*) - count(DFF) AS n1, count(*) - count(DGS10) AS n2 FROM w),
st AS (SELECT date_diff('day', lag(date) OVER (ORDER BY date), date) AS step FROM w),
sc AS (SELECT step, count(*) AS k FROM st WHERE step IS NOT NULL GROUP BY 1),
gp AS (SELECT sum(k) FILTER (WHERE step > 1.5 * (SELECT step FROM sc ORDER BY k DESC, step LIMIT 1)) AS k FROM sc),
dr AS (SELECT sum(c - 1)::BIGINT AS k FROM (SELECT count(*) AS c FROM w GROUP BY DFF, DGS10)),
res AS (SELECT 'INFO' AS severity, 'index' AS category, 'date' AS "column", NULL::BIGINT AS row_count, NULL::DOUBLE AS percentage FROM a
  UNION ALL SELECT 'WARNING', 'structure', NULL, n, NULL FROM a WHERE n > 0 AND n < 10
  UNION ALL SELECT 'ERROR', 'value_ranges', 'DFF', hi, hi / n * 100 FROM a WHERE hi > 0
  UNION ALL SELECT 'ERROR', 'value_ranges', 'DGS10', lo, lo / n * 100 FROM a WHERE lo > 0
  UNION ALL SELECT 'WARNING', 'missing_data', NULL, NULL, (n1 + n2) / (2 * n) * 100 FROM a WHERE (n1 + n2) / (2 * n) > 0.2
  UNION ALL SELECT 'ERROR', 'missing_data', NULL, bare, NULL FROM a WHERE bare > 0
  UNION ALL SELECT CASE WHEN n1 / n > 0.5 THEN 'ERROR' ELSE 'WARNING' END, 'missing_data', 'DFF', n1, n1 / n * 100 FROM a WHERE n1 / n > 0.1
  UNION ALL SELECT CASE WHEN n2 / n > 0.5 THEN 'ERROR' ELSE 'WARNING' END, 'missing_data', 'DGS10', n2, n2 / n * 100 FROM a WHERE n2 / n > 0.1
  UNION ALL SELECT 'WARNING', 'business_logic', 'DFF', r1, NULL FROM a WHERE r1 > 0
  UNION ALL SELECT 'WARNING', 'business_logic', 'DGS10', r2, NULL FROM a WHERE r2 > 0
  UNION ALL SELECT 'WARNING', 'duplicates', NULL, k, k / n * 100 FROM dr, a WHERE k > 0
  UNION ALL SELECT 'WARNING', 'time_series', NULL, k::BIGINT, NULL FROM gp WHERE k > 0
  UNION ALL {_outliers_sql("w", "DFF", "DGS10")})""",
)
def economic_quality(spark, sf):
    m = fx.macro(spark, sf)
    wide = m.groupBy("date").agg(
        (F.max(F.when(C("series_id") == "QTY", C("value"))) * 2).alias("DFF"), (F.max(F.when(C("series_id") == "TAX", C("value"))) - 4).alias("DGS10")
    )
    return val.validate_economic(wide, by=(), ts="date", now=NOW)[0]


# ------------------------------------------------------------ history
# A run per symbol group (symbol number mod 12 = day of the run), in two categories.
_RUNS = f"""{_FAULTY},{_REPORT},
tag AS (SELECT *, TIMESTAMP '2024-03-01 06:00:00' + to_days(CAST(CAST(substr(symbol, 2) AS BIGINT) % 12 AS INTEGER)) AS run_ts,
  CASE WHEN CAST(substr(symbol, 2) AS BIGINT) % 2 = 0 THEN 'market' ELSE 'index' END AS category, (warning_issues < 3) AS ok FROM reports),
runs AS (SELECT run_ts, category, count(*) AS total_datasets, count(*) FILTER (WHERE ok) AS datasets_passed, count(*) FILTER (WHERE ok) / count(*) * 100 AS pass_rate,
  avg(quality_score) AS avg_quality_score, sum(total_issues)::BIGINT AS total_issues, sum(critical_issues)::BIGINT AS critical_issues,
  sum(error_issues)::BIGINT AS error_issues, sum(warning_issues)::BIGINT AS warning_issues FROM tag GROUP BY 1, 2)"""


def _tags(df):
    number = F.substring("symbol", 2, 18).cast("bigint")
    return df.withColumns(
        {
            "run_ts": F.expr("timestamp_ntz'2024-03-01 06:00:00'") + F.make_dt_interval((number % 12).cast("int")),
            "category" if "category" not in df.columns else "run_category": F.when(number % 2 == 0, "market").otherwise("index"),
        }
    )


def _runs(spark, sf):
    issues, reports = _checked(spark, sf)
    tagged = _tags(reports.withColumn("is_valid", C("warning_issues") < 3))
    return hist.run_summary(tagged), _tags(issues)


@query(
    "quality_runs",
    Shape(["category"], [], ["total_datasets", "datasets_passed", "total_issues", "critical_issues", "error_issues", "warning_issues"], ["pass_rate", "avg_quality_score"], [], ["run_ts"]),
    f"{_RUNS}, res AS (SELECT * FROM runs)",
)
def quality_runs(spark, sf):
    return _runs(spark, sf)[0]


def _dir(value: str, order: str) -> str:
    return f"CASE WHEN count(*) < 2 THEN 'insufficient_data' WHEN regr_slope({value}, {order}) > 0.1 THEN 'improving' WHEN regr_slope({value}, {order}) < -0.1 THEN 'declining' ELSE 'stable' END"


_TREND_COLS = """count(*) AS runs, avg(pass_rate) AS avg_pass_rate, avg(avg_quality_score) AS avg_quality_score, sum(total_datasets)::BIGINT AS datasets,
  sum(total_issues)::BIGINT AS issues, sum(error_issues)::BIGINT AS error_issues, avg(warning_issues) AS avg_warning_issues"""


@query(
    "quality_trends",
    Shape(["category"], [], ["runs", "datasets", "issues", "error_issues", "pass_rate_trend", "quality_score_trend", "issue_count_trend"], ["avg_pass_rate", "avg_quality_score", "avg_warning_issues"]),
    f"""{_RUNS},
o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY run_ts) AS ix FROM runs WHERE run_ts >= '2024-03-03'),
res AS (SELECT category, {_TREND_COLS}, {_dir("pass_rate", "ix")} AS pass_rate_trend, {_dir("avg_quality_score", "ix")} AS quality_score_trend,
  {_dir("total_issues", "ix")} AS issue_count_trend FROM o GROUP BY 1)""",
)
def quality_trends(spark, sf):
    return hist.trends(_runs(spark, sf)[0], since="2024-03-03", by_category=True)


@query(
    "quality_trends_overall",
    Shape([], [], ["runs", "datasets", "issues", "pass_rate_trend", "issue_count_trend"], ["avg_pass_rate", "avg_quality_score"]),
    f"""{_RUNS},
o AS (SELECT *, row_number() OVER (ORDER BY run_ts, category) AS ix FROM runs),
res AS (SELECT {_TREND_COLS}, {_dir("pass_rate", "ix")} AS pass_rate_trend, {_dir("total_issues", "ix")} AS issue_count_trend FROM o)""",
)
def quality_trends_overall(spark, sf):
    return hist.trends(_runs(spark, sf)[0])


@query(
    "quality_alerts",
    Shape([], [], ["severity", "type"], ["value"], [], ["run_ts"]),
    f"""{_RUNS},
l AS (SELECT * FROM runs ORDER BY run_ts DESC, category DESC LIMIT 1),
res AS (SELECT run_ts, 'warning' AS severity, 'low_pass_rate' AS type, pass_rate AS value FROM l WHERE pass_rate < 80
  UNION ALL SELECT run_ts, 'warning', 'low_quality_score', avg_quality_score FROM l WHERE avg_quality_score < 70
  UNION ALL SELECT run_ts, 'critical', 'critical_issues', critical_issues FROM l WHERE critical_issues > 0
  UNION ALL SELECT run_ts, 'error', 'error_issues', error_issues FROM l WHERE error_issues > 5)""",
)
def quality_alerts(spark, sf):
    return hist.alerts(_runs(spark, sf)[0])


@query(
    "quality_recommendations",
    Shape([], [], ["recommendation"]),
    f"""{_RUNS},
r AS (SELECT * FROM runs ORDER BY run_ts DESC, category LIMIT 10),
c AS (SELECT i.category, count(*) AS n FROM issues i JOIN tag t USING (symbol) JOIN r ON r.run_ts = t.run_ts AND r.category = t.category GROUP BY 1),
res AS (SELECT CASE category WHEN 'missing_data' THEN 'collect data more robustly to reduce missing values' WHEN 'outliers' THEN 'detect and handle outliers in preprocessing'
    WHEN 'business_logic' THEN 'review and strengthen the business rules' ELSE 'validate and convert data types automatically' END AS recommendation FROM c
  WHERE (category = 'missing_data' AND n > 5) OR (category = 'outliers' AND n > 3) OR (category = 'business_logic' AND n > 2) OR (category = 'data_types' AND n > 2)
  UNION ALL SELECT 'pass rate is below 80: review the validation thresholds' FROM (SELECT avg(pass_rate) AS p FROM r) WHERE p < 80
  UNION ALL SELECT 'quality score is below 70: tighten data quality controls' FROM (SELECT avg(avg_quality_score) AS q FROM r) WHERE q < 70)""",
)
def quality_recommendations(spark, sf):
    return hist.recommendations(*_runs(spark, sf))


@query(
    "operation_latency",
    Shape(["operation"], [], ["calls"], ["avg_time", "min_time", "max_time"], ["total_time"]),
    """l AS (SELECT event_type AS operation, round(value * 100) AS seconds FROM events),
res AS (SELECT operation, count(*) AS calls, sum(seconds) AS total_time, avg(seconds) AS avg_time, min(seconds) AS min_time, max(seconds) AS max_time FROM l GROUP BY 1)""",
)
def operation_latency(spark, sf):
    log = fx.table(spark, sf, "events").select(C("event_type").alias("operation"), F.round(C("value") * 100).alias("seconds"))
    return hist.operation_latency(log)
