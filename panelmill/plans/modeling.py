"""Forecast, evaluation and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.axis import Axis
from ..functions.smoothing import HOLT_GRID, SEASONAL_GRID, THETA_GRID
from ..operators import evaluate as ev
from ..operators import forecast as fc
from ..operators import ml
from ..operators import unified as un
from ..session import settle, written
from . import fixtures as fx
from .catalog import REGISTRY, Shape, query
from .cleaning import CALENDAR_SQL
from .market import _regime_sql, _unified_sql
from .sqlkit import wins

C = F.col
BARS, LEVELS, PREDS = fx.BARS_SQL, fx.LEVELS_SQL, fx.PREDS_SQL
BY_MODEL = Axis(key=("symbol", "model"))
_PRICES = ["open", "high", "low", "close", "volume"]


# ------------------------------------------------------------ targets and windows
@query(
    "forward_return",
    Shape(["symbol"], ["ts"], [], ["target", "target_5"]),
    f"{BARS}, res AS (SELECT *, lead(close) OVER w / close - 1 AS target, lead(close, 5) OVER w / close - 1 AS target_5 FROM bars {wins()})",
)
def forward_return(spark, sf):
    return fc.forward_return(fc.forward_return(fx.bars(spark, sf)), 5, out="target_5")


@query(
    "train_windows",
    Shape(["symbol"], ["ts"], ["rows", "steps"], ["last_return"], ["total"]),
    f"""{BARS},
w0 AS (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS c, list(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS v,
  list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS p, lag(close) OVER w AS base FROM bars {wins()}),
res AS (SELECT symbol, ts, 10 AS rows, 3 AS steps, p[3] / base - 1 AS last_return, list_sum(c) + list_sum(v) AS total FROM w0 WHERE len(c) = 10 AND len(p) = 3)""",
)
def train_windows(spark, sf):
    w = fc.training_windows(fx.bars(spark, sf), ["close", "volume"], 10, 3)
    flat = F.aggregate(F.flatten("window"), F.lit(0.0), lambda a, x: a + x)
    return w.select("symbol", "ts", F.size("window").alias("rows"), F.size("path").alias("steps"), F.element_at("path", 3).alias("last_return"), flat.alias("total"))


@query(
    "horizon_windows",
    Shape(["symbol"], ["ts"], ["rows"], ["target"]),
    f"""{BARS},
w0 AS (SELECT *, row_number() OVER w AS rn, lead(close, 4) OVER w / close - 1 AS target FROM bars {wins()}),
res AS (SELECT symbol, ts, 12 AS rows, target FROM w0 WHERE rn > 12 AND target IS NOT NULL)""",
)
def horizon_windows(spark, sf):
    return fc.horizon_windows(fx.bars(spark, sf), ["close"], 12, 4).withColumn("rows", F.size("window"))


@query(
    "price_windows",
    Shape(["symbol"], ["ts"], [], [], ["first", "last", "total"]),
    f"""{BARS},
w0 AS (SELECT *, lead(close, 14) OVER w AS last, sum(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS total FROM bars {wins()}),
res AS (SELECT symbol, ts, close AS first, last, total FROM w0 WHERE last IS NOT NULL)""",
)
def price_windows(spark, sf):
    p = fc.price_windows(fx.bars(spark, sf), 10, 5)
    total = F.aggregate("prices", F.lit(0.0), lambda a, x: a + x)
    return p.select("symbol", "ts", F.element_at("prices", 1).alias("first"), F.element_at("prices", -1).alias("last"), total.alias("total"))


@query("long_format", Shape(["unique_id"], ["ds"], [], [], ["y"]), f"{BARS}, res AS (SELECT symbol AS unique_id, ts AS ds, close AS y FROM bars)")
def long_format(spark, sf):
    return fc.long_format(fx.bars(spark, sf))


_METRIC_SQL = """avg((actual - predicted) ** 2) AS mse, sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(abs(actual - predicted)) AS mae,
  avg(abs(actual - predicted) / greatest((abs(actual) + abs(predicted)) / 2, 1e-8)) * 100 AS smape,
  avg(CASE WHEN (actual > 0) = (predicted > 0) THEN 1.0 ELSE 0.0 END) * 100 AS direction_accuracy,
  CASE WHEN min(actual) < max(actual) AND min(predicted) < max(predicted) THEN corr(actual, predicted) ELSE 0 END AS correlation,
  avg(actual) AS mean_actual, avg(predicted) AS mean_predicted, stddev_pop(actual) AS std_actual, stddev_pop(predicted) AS std_predicted,
  avg(predicted) - avg(actual) AS prediction_bias, count(*) AS num_samples"""


# ------------------------------------------------------------ forecasts
_SIGNAL = """CASE WHEN r > 0.02 THEN 'buy' WHEN r < -0.02 THEN 'sell' ELSE 'hold' END AS signal,
  CASE WHEN abs(r) > 0.02 THEN least(abs(r) / 0.05, 1.0) ELSE 0.5 - abs(r) / 0.04 END AS strength"""
_FALLBACK = f"""{LEVELS},
r0 AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM levels {wins()}),
r1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM r0 WHERE ret IS NOT NULL),
r2 AS (SELECT symbol, max(close) FILTER (WHERE back = 1) AS current_price, avg(ret) AS m, stddev_samp(ret) AS s FROM r1 WHERE back <= 20 GROUP BY 1),
fb AS (SELECT symbol, current_price, m * 5 AS r, current_price * (1 + m * 5) AS predicted_price, current_price * (1 + m * 5 - 2 * s * sqrt(5)) AS lower,
  current_price * (1 + m * 5 + 2 * s * sqrt(5)) AS upper FROM r2)"""


@query(
    "fallback_forecast",
    Shape(["symbol"], [], ["signal"], ["predicted_return", "strength"], ["current_price", "predicted_price", "lower", "upper"]),
    f"{_FALLBACK}, res AS (SELECT *, r AS predicted_return, {_SIGNAL} FROM fb)",
)
def fallback_forecast(spark, sf):
    return fc.fallback_forecast(fx.levels(spark, sf))


@query(
    "batch_forecast",
    Shape(["symbol"], [], ["status"], [], ["predicted_price", "band_low"]),
    f"""{_FALLBACK},
req AS (SELECT 'S' || (s_suppkey * 2) AS symbol FROM supplier),
res AS (SELECT symbol, CASE WHEN predicted_price IS NULL THEN 'no data' ELSE 'ok' END AS status, predicted_price, predicted_price * 0.95 AS band_low FROM req LEFT JOIN fb USING (symbol))""",
)
def batch_forecast(spark, sf):
    wanted = fx.table(spark, sf, "supplier").select(F.concat(F.lit("S"), C("s_suppkey") * 2).alias("symbol"))
    done, failed = fc.batch_forecast(wanted, fx.levels(spark, sf))
    ok = fc.price_from_return(done).select("symbol", F.lit("ok").alias("status"), "predicted_price", C("lower").alias("band_low"))
    none = F.lit(None).cast("double")
    return ok.unionByName(failed.select("symbol", F.lit("no data").alias("status"), none.alias("predicted_price"), none.alias("band_low")))


_FUTURE = """
fl AS (SELECT symbol, max(ts) AS last_ts FROM levels GROUP BY 1),
fd AS (SELECT symbol, CAST(last_ts + to_days(CAST(i AS INTEGER)) AS DATE) AS ts FROM fl, generate_series(1, 14) g(i)),
fs AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS INTEGER) AS step FROM fd WHERE isodow(ts) < 6)"""


@query(
    "naive_forecast",
    Shape(["symbol"], ["ts"], ["step", "model"], [], ["predicted", "lower", "upper"]),
    f"""{LEVELS},{_FUTURE},
e AS (SELECT *, close - lag(close) OVER w AS err FROM levels {wins()}),
g AS (SELECT symbol, max_by(close, ts) AS y, stddev_samp(err) AS sd FROM e GROUP BY 1),
res AS (SELECT symbol, ts, step, 'naive' AS model, y AS predicted, y - 1.6448536269514722 * sd * sqrt(step) AS lower, y + 1.6448536269514722 * sd * sqrt(step) AS upper
  FROM fs JOIN g USING (symbol) WHERE step <= 5)""",
)
def naive_forecast(spark, sf):
    return fc.forecast(fx.levels(spark, sf), ["naive"])


_ALPHAS = ", ".join(f"({0.05 + 0.05 * i!r})" for i in range(19))


@query(
    "theta_forecast",
    Shape(["symbol"], ["ts"], ["step"], [], [], [], ["predicted"]),
    f"""{LEVELS},{_FUTURE},
ti AS MATERIALIZED (SELECT symbol, close, row_number() OVER w AS rn FROM levels {wins()}),
ta AS (SELECT CAST(a AS DOUBLE) AS a FROM (VALUES {_ALPHAS}) t(a)),
tr AS (SELECT symbol, rn, a, close AS level, 0.0::DOUBLE AS sse FROM ti, ta WHERE rn = 1
  UNION ALL SELECT i.symbol, i.rn, t.a, t.level + t.a * (i.close - t.level), t.sse + (i.close - t.level) * (i.close - t.level) FROM tr t JOIN ti i ON i.symbol = t.symbol AND i.rn = t.rn + 1),
tn AS (SELECT symbol, count(*) AS n, regr_slope(close, rn) AS slope FROM ti GROUP BY 1),
tb AS (SELECT symbol, min_by(level, sse) AS level, min_by(a, sse) AS a FROM tr JOIN tn USING (symbol) WHERE rn = n GROUP BY 1),
res AS (SELECT symbol, ts, step, level + 0.5 * slope * (step - 1 + (1 - pow(1 - a, n)) / a) AS predicted FROM fs JOIN tb USING (symbol) JOIN tn USING (symbol) WHERE step <= 5)""",
)
def theta_forecast(spark, sf):
    return fc.forecast(fx.levels(spark, sf), ["theta"])


def _values(grid) -> str:
    return ", ".join("(" + ", ".join(map(repr, [i, *map(float, row)])) + ")" for i, row in enumerate(grid))


_Z90 = 1.6448536269514722
# seasonal smoothing of the logs: the season is a list whose first element is the one of the row
_HOLT = f"""{LEVELS},{_FUTURE},
hx AS MATERIALIZED (SELECT symbol, ln(close) AS y, row_number() OVER w AS rn FROM levels {wins()}),
hn AS MATERIALIZED (SELECT symbol, count(*) AS n, avg(y) FILTER (WHERE rn <= 5) AS m, avg(y) FILTER (WHERE rn BETWEEN 6 AND 10) AS m2, list(y ORDER BY rn) AS ys, regr_slope(y, rn) AS slope FROM hx GROUP BY 1),
hg AS (SELECT nr, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c FROM (VALUES {_values(SEASONAL_GRID)}) t(nr, a, b, c)),
hr AS (SELECT n.symbol, 0::BIGINT AS rn, g.nr, g.a, g.b, g.c, n.m AS l, (n.m2 - n.m) / 5 AS t, list_transform(n.ys[1:5], lambda v: v - n.m) AS s, 0.0::DOUBLE AS e FROM hn n, hg g
  UNION ALL SELECT r.symbol, x.rn, r.nr, r.a, r.b, r.c, r.l + r.t + r.a * (x.y - (r.l + r.t + r.s[1])), r.t + r.a * r.b * (x.y - (r.l + r.t + r.s[1])),
  list_append(r.s[2:], r.s[1] + r.c * (1 - r.a) * (x.y - (r.l + r.t + r.s[1]))), x.y - (r.l + r.t + r.s[1]) FROM hr r JOIN hx x ON x.symbol = r.symbol AND x.rn = r.rn + 1),
hb AS (SELECT symbol, arg_min(nr, sse) AS nr FROM (SELECT symbol, nr, sum(e * e) AS sse FROM hr GROUP BY 1, 2) GROUP BY 1),
hh AS MATERIALIZED (SELECT r.* FROM hr r JOIN hb b ON b.symbol = r.symbol AND b.nr = r.nr),
tg AS (SELECT nr, a::DOUBLE AS a FROM (VALUES {_values([(x,) for x in THETA_GRID])}) t(nr, a)),
tr AS (SELECT x.symbol, x.rn, g.nr, g.a, x.y AS l, 0.0::DOUBLE AS e FROM hx x, tg g WHERE x.rn = 1
  UNION ALL SELECT r.symbol, x.rn, r.nr, r.a, r.l + r.a * (x.y - r.l), x.y - r.l FROM tr r JOIN hx x ON x.symbol = r.symbol AND x.rn = r.rn + 1),
tb AS (SELECT symbol, arg_min(nr, sse) AS nr FROM (SELECT symbol, nr, sum(e * e) AS sse FROM tr GROUP BY 1, 2) GROUP BY 1),
tt AS MATERIALIZED (SELECT r.* FROM tr r JOIN tb b ON b.symbol = r.symbol AND b.nr = r.nr),
nv AS (SELECT symbol, rn, y - lag(y, 5) OVER (PARTITION BY symbol ORDER BY rn) AS e FROM hx),
se AS (SELECT h.symbol, stddev_samp(h.e) AS s_holt, stddev_samp((h.e + t.e + v.e) / 3) FILTER (WHERE h.rn > 5) AS s_all
  FROM hh h LEFT JOIN tt t ON t.symbol = h.symbol AND t.rn = h.rn LEFT JOIN nv v ON v.symbol = h.symbol AND v.rn = h.rn WHERE h.rn > 0 GROUP BY 1),
pa AS (SELECT f.symbol, f.ts, f.step, h.l + f.step * h.t + h.s[(f.step - 1) % 5 + 1] AS p_holt,
  t.l + 0.5 * n.slope * (f.step - 1 + (1 - pow(1 - t.a, n.n)) / t.a) AS p_theta, n.ys[n.n - 5 + (f.step - 1) % 5 + 1] AS p_naive, s_holt, s_all
  FROM fs f JOIN hn n USING (symbol) JOIN hh h ON h.symbol = f.symbol AND h.rn = n.n JOIN tt t ON t.symbol = f.symbol AND t.rn = n.n JOIN se ON se.symbol = f.symbol WHERE f.step <= 5),
pb AS (SELECT symbol, ts, step, 'exp_smoothing' AS model, p_holt AS p, s_holt AS s FROM pa UNION ALL SELECT symbol, ts, step, 'ensemble', (p_holt + p_theta + p_naive) / 3, s_all FROM pa),
res AS (SELECT *, exp(p) AS predicted, exp(p - {_Z90} * s * sqrt(step)) AS lower, exp(p + {_Z90} * s * sqrt(step)) AS upper FROM pb)"""


@query("holt_forecast", Shape(["symbol"], ["ts"], ["step", "model"], [], [], [], ["predicted", "lower", "upper"]), _HOLT)
def holt_forecast(spark, sf):
    return fc.forecast(fx.levels(spark, sf), ["exp_smoothing", "ensemble"], seasonal_period=5, log=True)


def _fold_sql(y: str, source: str, keys: str) -> str:
    """Smoothing and theta over list ``y`` of every row of ``source``: hf(keys, l, t) and tf(keys, l, a) with least squared error."""
    return f"""
hg AS (SELECT nr, a::DOUBLE AS a, b::DOUBLE AS b FROM (VALUES {_values([r[:2] for r in HOLT_GRID])}) t(nr, a, b)),
tg AS (SELECT nr, a::DOUBLE AS a FROM (VALUES {_values([(x,) for x in THETA_GRID])}) t(nr, a)),
hf AS MATERIALIZED (SELECT {keys}, arg_min(f, f.q) AS f FROM (SELECT {keys}, list_reduce(
    list_prepend({{'y': 0.0::DOUBLE, 'l': {y}[1], 't': {y}[2] - {y}[1], 'q': 0.0::DOUBLE}}, list_transform({y}[2:], lambda v: {{'y': v, 'l': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'q': 0.0::DOUBLE}})),
    lambda x, z: {{'y': z.y, 'l': x.l + x.t + a * (z.y - (x.l + x.t)), 't': x.t + a * b * (z.y - (x.l + x.t)), 'q': x.q + (z.y - (x.l + x.t)) * (z.y - (x.l + x.t))}}) AS f
  FROM {source}, hg) GROUP BY ALL),
tf AS MATERIALIZED (SELECT {keys}, arg_min(f.l, f.q) AS l, arg_min(a, f.q) AS a FROM (SELECT {keys}, a, list_reduce(
    list_prepend({{'y': 0.0::DOUBLE, 'l': {y}[1], 'q': 0.0::DOUBLE}}, list_transform({y}, lambda v: {{'y': v, 'l': 0.0::DOUBLE, 'q': 0.0::DOUBLE}})),
    lambda x, z: {{'y': z.y, 'l': x.l + a * (z.y - x.l), 'q': x.q + (z.y - x.l) * (z.y - x.l)}}) AS f
  FROM {source}, tg) GROUP BY ALL)"""


_CV = f"""{LEVELS},
ly AS (SELECT symbol, list(close ORDER BY ts) AS ys, count(*) AS n FROM levels GROUP BY 1),
fw AS MATERIALIZED (SELECT symbol, fold, n // 6 AS w, ys[fold + 1:fold + n // 6] AS y, ys[fold + n // 6 + 1:fold + n // 6 + 30] AS ahead
  FROM (SELECT *, unnest(generate_series(0, n - n // 6 - 30)) AS fold FROM ly WHERE n // 6 >= 3 AND n >= n // 6 + 30)),
{_fold_sql("y", "fw", "symbol, fold").strip()},
sl AS (SELECT symbol, fold, regr_slope(v, i) AS slope FROM (SELECT symbol, fold, unnest(y) AS v, unnest(generate_series(1, w)) AS i FROM fw) GROUP BY 1, 2),
ah AS (SELECT symbol, fold, w, y[w] AS last, unnest(ahead) AS actual, unnest(generate_series(1, 30)) AS k FROM fw),
pr AS (SELECT a.symbol, a.fold, a.actual, h.f.l + k * h.f.t AS p1, t.l + 0.5 * s.slope * (k - 1 + (1 - pow(1 - t.a, a.w)) / t.a) AS p2, a.last AS p3
  FROM ah a JOIN hf h ON h.symbol = a.symbol AND h.fold = a.fold JOIN tf t ON t.symbol = a.symbol AND t.fold = a.fold JOIN sl s ON s.symbol = a.symbol AND s.fold = a.fold),
cvp AS (SELECT symbol, fold, 'exp_smoothing' AS model, actual, p1 AS predicted FROM pr UNION ALL SELECT symbol, fold, 'theta', actual, p2 FROM pr UNION ALL SELECT symbol, fold, 'naive', actual, p3 FROM pr),
cvm AS MATERIALIZED (SELECT symbol, fold, model, {_METRIC_SQL} FROM cvp GROUP BY 1, 2, 3)"""


@query("cross_validation", Shape(["symbol"], [], ["model", "fold", "num_samples"], ["smape", "direction_accuracy"], ["rmse", "mae"]), f"{_CV}, res AS (SELECT * FROM cvm)")
def cross_validation(spark, sf):
    return fc.cross_validate(fx.levels(spark, sf))


@query(
    "naive_cross_validation",
    Shape(["symbol"], [], ["fold", "num_samples"], ["smape"], ["mae"]),
    f"""{LEVELS},
n AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM levels {wins()}),
f AS (SELECT symbol, n, n // 6 AS width, unnest(generate_series(0, n - n // 6 - 30)) AS fold FROM (SELECT DISTINCT symbol, n FROM n)),
p AS (SELECT f.symbol, f.fold, b.close AS predicted, t.close AS actual FROM f JOIN n b ON b.symbol = f.symbol AND b.rn = f.fold + f.width
  JOIN n t ON t.symbol = f.symbol AND t.rn > f.fold + f.width AND t.rn <= f.fold + f.width + 30),
res AS (SELECT symbol, fold, count(*) AS num_samples, avg(abs(actual - predicted)) AS mae, avg(abs(actual - predicted) / ((abs(actual) + abs(predicted)) / 2)) * 100 AS smape FROM p GROUP BY 1, 2)""",
)
def naive_cross_validation(spark, sf):
    return fc.cross_validate(fx.levels(spark, sf), ["naive"])


_whole = _fold_sql("ys", "ly", "symbol").replace("hg AS", "hg2 AS").replace("tg AS", "tg2 AS").replace("ly, hg)", "ly, hg2)").replace("ly, tg)", "ly, tg2)").replace("hf AS", "hf2 AS").replace("tf AS", "tf2 AS")
_BEST = f"""{_CV},{_FUTURE},{_whole},
bm AS (SELECT symbol, model, avg(smape) AS smape FROM cvm GROUP BY 1, 2),
bb AS (SELECT symbol, arg_min(model, (smape, model)) AS model FROM bm GROUP BY 1),
bs AS (SELECT symbol, regr_slope(v, i) AS slope FROM (SELECT symbol, unnest(ys) AS v, unnest(generate_series(1, n)) AS i FROM ly) GROUP BY 1),
res AS (SELECT f.symbol, f.ts, f.step, b.model, CASE b.model WHEN 'exp_smoothing' THEN h.f.l + f.step * h.f.t
    WHEN 'theta' THEN t.l + 0.5 * s.slope * (f.step - 1 + (1 - pow(1 - t.a, y.n)) / t.a) ELSE y.ys[y.n] END AS predicted
  FROM fs f JOIN bb b USING (symbol) JOIN ly y ON y.symbol = f.symbol JOIN hf2 h ON h.symbol = f.symbol JOIN tf2 t ON t.symbol = f.symbol JOIN bs s ON s.symbol = f.symbol WHERE f.step <= 5)"""


@query("best_forecaster", Shape(["symbol"], ["ts"], ["step", "model"], [], ["predicted"]), _BEST)
def best_forecaster(spark, sf):
    return fc.select_best(fx.levels(spark, sf))[0]


# ------------------------------------------------------------ evaluation

_FM = ["mse", "rmse", "mae", "smape", "direction_accuracy", "correlation"]
_SCORED = f"{PREDS}, fm AS (SELECT symbol, model, {_METRIC_SQL} FROM preds GROUP BY 1, 2)"


@query(
    "forecast_metrics",
    Shape(["symbol"], [], ["model", "num_samples"], [*_FM, "mean_actual", "mean_predicted", "std_actual", "std_predicted", "prediction_bias"]),
    f"{_SCORED}, res AS (SELECT * FROM fm)",
)
def forecast_metrics(spark, sf):
    return ev.forecast_metrics(fx.predictions(spark, sf))


@query(
    "regression_metrics",
    Shape(["model"], [], [], ["mse", "rmse", "mae", "r2", "smape"]),
    f"""{PREDS},
res AS (SELECT model, avg((actual - predicted) ** 2) AS mse, sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(abs(actual - predicted)) AS mae,
  1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) AS r2, avg(2 * abs(actual - predicted) / (abs(actual) + abs(predicted) + 1e-8)) * 100 AS smape FROM preds GROUP BY 1)""",
)
def regression_metrics(spark, sf):
    return ev.regression_metrics(fx.predictions(spark, sf), ["model"], "actual", "predicted")


def _lagged(k: int) -> str:
    e = "predicted" if k == 0 else f"lead(predicted, {k}) OVER w" if k > 0 else f"lag(predicted, {-k}) OVER w"
    return f"SELECT symbol, model, {k} AS lag, actual, {e} AS p FROM preds WINDOW w AS (PARTITION BY symbol, model ORDER BY ts)"


_LAGS = f"""{PREDS}, ll AS ({" UNION ALL ".join(_lagged(k) for k in range(-3, 4))}),
scan AS (SELECT symbol, model, lag, CASE WHEN min(actual) < max(actual) AND min(p) < max(p) THEN corr(actual, p) ELSE 0 END AS correlation FROM ll WHERE p IS NOT NULL GROUP BY 1, 2, 3)"""


@query("lag_alignment", Shape(["symbol"], [], ["model", "lag"], ["correlation"]), f"{_LAGS}, res AS (SELECT * FROM scan)")
def lag_alignment(spark, sf):
    return ev.lag_scan(fx.predictions(spark, sf))


@query(
    "best_lag",
    Shape(["symbol"], [], ["model", "best_lag", "alignment_warning", "alignment_issue"], ["best_correlation", "correlation"]),
    f"""{_LAGS},
o AS (SELECT *, row_number() OVER (PARTITION BY symbol, model ORDER BY round(abs(correlation), 12) DESC, lag) AS rn, max(correlation) FILTER (WHERE lag = 0) OVER (PARTITION BY symbol, model) AS zero FROM scan),
res AS (SELECT symbol, model, lag AS best_lag, correlation AS best_correlation, zero AS correlation, abs(correlation) > 0.1 AND lag <> 0 AS alignment_warning,
  lag <> 0 AND abs(correlation) > abs(zero) AS alignment_issue FROM (SELECT symbol, model, lag, correlation, zero FROM o WHERE rn = 1))""",
)
def best_lag(spark, sf):
    return ev.best_lag(ev.lag_scan(fx.predictions(spark, sf)))


_FOLDS = f"""{PREDS},
bk AS (SELECT *, row_number() OVER (PARTITION BY symbol, model ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY symbol, model) AS n FROM preds),
fo AS (SELECT *, 5 - 1 - (back - 1) // 30 AS fold FROM bk WHERE back <= 150),
ff AS (SELECT symbol, model, CAST(fold AS INTEGER) AS fold, {_METRIC_SQL} FROM fo GROUP BY 1, 2, 3)"""


@query("rolling_folds", Shape(["symbol"], [], ["model", "fold", "num_samples"], _FM), f"{_FOLDS}, res AS (SELECT * FROM ff)")
def rolling_folds(spark, sf):
    return ev.rolling_evaluation(fx.predictions(spark, sf))


@query(
    "fold_summary",
    Shape(["symbol"], [], ["model", "folds", "total_samples"], [f"{m}_{s}" for m in _FM for s in ("mean", "std", "min", "max")]),
    f"""{_FOLDS},
res AS (SELECT symbol, model, count(*) AS folds, sum(num_samples)::BIGINT AS total_samples,
  {", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max" for m in _FM)} FROM ff GROUP BY 1, 2)""",
)
def fold_summary(spark, sf):
    return ev.fold_summary(ev.rolling_evaluation(fx.predictions(spark, sf)))


_PAIRED = f"""{PREDS}, er AS (SELECT *, abs(actual - predicted) AS e FROM preds),
pp AS (SELECT a.symbol, a.model AS model_a, b.model AS model_b, a.e AS ea, b.e AS eb FROM er a JOIN er b ON a.symbol = b.symbol AND a.ts = b.ts
  WHERE (a.model, b.model) IN (('naive', 'mom1'), ('naive', 'mean5'), ('mom1', 'mean5'))),
pt AS (SELECT symbol, model_a, model_b, avg(ea - eb) / (stddev_samp(ea - eb) / sqrt(count(*))) AS t_statistic, count(*) AS n, avg(ea) AS mean_error_a, avg(eb) AS mean_error_b FROM pp GROUP BY 1, 2, 3)"""


@query(
    "paired_t",
    Shape(["symbol"], [], ["model_a", "model_b", "n"], ["t_statistic", "mean_error_a", "mean_error_b"]),
    f"{_PAIRED}, res AS (SELECT * FROM pt)",
)
def paired_t(spark, sf):
    return ev.paired_t(fx.predictions(spark, sf), ["naive", "mom1", "mean5"])


# the share of Student's t within +-t as a finite sum of powers of the cosine, for whole degrees of freedom
_PAIRED_P = f"""{_PAIRED},
an AS (SELECT symbol, model_a, model_b, n - 1 AS v, atan(abs(t_statistic) / sqrt(n - 1)) AS theta FROM pt WHERE n > 1),
tk AS (SELECT an.*, k.k, CASE WHEN k.k = 0 THEN 0.0 WHEN v % 2 = 0 THEN ln((2 * k.k - 1) / (2.0 * k.k)) ELSE ln(2 * k.k / (2 * k.k + 1.0)) END AS step
  FROM an JOIN range(100000) k(k) ON k.k <= greatest(0, (v - 2 - v % 2) // 2)),
ts AS (SELECT *, exp(sum(step) OVER (PARTITION BY symbol, model_a, model_b ORDER BY k) + (2 * k + v % 2) * ln(cos(theta))) AS term FROM tk),
tw AS (SELECT symbol, model_a, model_b, any_value(v) AS v, any_value(theta) AS theta, sum(term) AS terms FROM ts GROUP BY 1, 2, 3),
pv AS (SELECT *, 1 - CASE WHEN v % 2 = 0 THEN sin(theta) * terms WHEN v = 1 THEN 2 / pi() * theta ELSE 2 / pi() * (theta + sin(theta) * terms) END AS p_value FROM tw),
res AS (SELECT p.symbol, p.model_a, p.model_b, w.p_value, coalesce(w.p_value < 0.05, FALSE) AS significant
  FROM pt p LEFT JOIN pv w ON w.symbol = p.symbol AND w.model_a = p.model_a AND w.model_b = p.model_b)"""


@query("paired_t_significance", Shape(["symbol"], [], ["model_a", "model_b", "significant"], ["p_value"]), _PAIRED_P)
def paired_t_significance(spark, sf):
    return ev.paired_t(fx.predictions(spark, sf), ["naive", "mom1", "mean5"])


@query(
    "model_rank",
    Shape(["symbol"], [], ["model", "rank"], ["smape"]),
    f"{_SCORED}, res AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY smape, model) AS INTEGER) AS rank FROM fm)",
)
def model_rank(spark, sf):
    return ev.rank_models(ev.forecast_metrics(fx.predictions(spark, sf)))


@query(
    "top_models",
    Shape(["symbol"], [], ["model"], ["rmse", "train_seconds"]),
    f"""{_SCORED}, res AS (SELECT symbol, model, rmse, num_samples * 0.001 AS train_seconds FROM fm ORDER BY rmse, symbol, model LIMIT 5)""",
)
def top_models(spark, sf):
    m = ev.forecast_metrics(fx.predictions(spark, sf))
    return ev.run_leaderboard(m, m.select("symbol", "model", (C("num_samples") * 0.001).alias("train_seconds")), score="rmse")


@query(
    "leaderboard",
    Shape(["model"], [], ["series"], ["smape_mean"]),
    f"{_FOLDS}, fs2 AS (SELECT symbol, model, avg(smape) AS s FROM ff GROUP BY 1, 2), res AS (SELECT model, avg(s) AS smape_mean, count(*) AS series FROM fs2 GROUP BY 1)",
)
def leaderboard(spark, sf):
    return ev.leaderboard(ev.fold_summary(ev.rolling_evaluation(fx.predictions(spark, sf))))


@query(
    "success_criteria",
    Shape(["symbol"], [], ["model", "smape_target", "direction_target", "correlation_target", "overall_success"], ["improvement_score"]),
    f"""{_SCORED},
res AS (SELECT *, smape < 50 AS smape_target, direction_accuracy >= 55 AS direction_target, correlation >= 0.3 AS correlation_target,
  smape < 50 AND direction_accuracy >= 55 AND correlation >= 0.3 AS overall_success,
  CAST(round(CAST((0.5 * greatest(0, least(1, (200 - smape) / 150)) + 0.3 * greatest(0, least(1, direction_accuracy / 60)) + 0.2 * greatest(0, least(1, (correlation + 1) / 1.3))) * 100 AS DECIMAL(38, 12)), 1) AS DOUBLE) AS improvement_score FROM fm)""",
)
def success_criteria(spark, sf):
    return ev.success_criteria(ev.forecast_metrics(fx.predictions(spark, sf)))


@query(
    "training_summary",
    Shape(["family"], [], ["attempted", "succeeded"], ["success_rate"]),
    f"""{_SCORED}, r AS (SELECT CASE model WHEN 'naive' THEN 'naive' ELSE 'mean' END AS family, correlation > 0 AS ok FROM fm),
res AS (SELECT family, count(*) AS attempted, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE ok) / count(*) * 100 AS success_rate FROM r GROUP BY 1
  UNION ALL SELECT 'ALL', count(*), count(*) FILTER (WHERE ok), count(*) FILTER (WHERE ok) / count(*) * 100 FROM r)""",
)
def training_summary(spark, sf):
    m = ev.forecast_metrics(fx.predictions(spark, sf))
    named = m.select(F.when(C("model") == "naive", "naive_last").otherwise(F.concat(F.lit("mean_"), "model")).alias("model"), (C("correlation") > 0).alias("succeeded"))
    return ev.training_summary(named)


@query(
    "price_metrics",
    Shape(["symbol"], [], ["n"], ["smape", "direction_accuracy"], ["rmse", "mae"]),
    f"""{LEVELS},
p AS (SELECT symbol, ts, close AS actual, lag(close) OVER w AS predicted FROM levels {wins()}),
q AS (SELECT *, actual - lag(actual) OVER w AS da, predicted - lag(predicted) OVER w AS dp FROM p WHERE predicted IS NOT NULL {wins()}),
res AS (SELECT symbol, count(*) AS n, sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(abs(actual - predicted)) AS mae, avg(abs(actual - predicted) / ((abs(actual) + abs(predicted)) / 2)) * 100 AS smape,
  avg(CASE WHEN da IS NOT NULL THEN CASE WHEN sign(da) = sign(dp) THEN 1.0 ELSE 0.0 END END) * 100 AS direction_accuracy FROM q GROUP BY 1)""",
)
def price_metrics(spark, sf):
    a = Axis()
    p = fx.levels(spark, sf).select("symbol", "ts", C("close").alias("actual"), a.lag("close").alias("predicted"))
    return ev.price_metrics(p.filter(C("predicted").isNotNull()), a)


_PATH = f"""{LEVELS},
b0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM levels),
b1 AS (SELECT symbol, max(close) FILTER (WHERE back = 11) AS base FROM b0 GROUP BY 1),
path AS (SELECT symbol, CAST(11 - back AS INTEGER) AS step, close / base - 1 AS actual, 0.001 * (11 - back) AS predicted FROM b0 JOIN b1 USING (symbol) WHERE back <= 10 AND base IS NOT NULL)"""


@query("holdout_path", Shape(["symbol"], [], ["step"], ["actual"]), f"{_PATH}, res AS (SELECT * FROM path)")
def holdout_path(spark, sf):
    return ev.holdout_path(fx.levels(spark, sf), 10)


@query(
    "path_metrics",
    Shape(["symbol"], [], ["n"], ["mse", "rmse", "last_mse"]),
    f"""{_PATH}, res AS (SELECT symbol, count(*) AS n, avg((actual - predicted) ** 2) AS mse, sqrt(avg((actual - predicted) ** 2)) AS rmse,
  max((actual - predicted) ** 2) FILTER (WHERE step = 10) AS last_mse FROM path GROUP BY 1)""",
)
def path_metrics(spark, sf):
    path = ev.holdout_path(fx.levels(spark, sf), 10)
    guess = path.select("symbol", "step", (C("step") * 0.001).alias("predicted"))
    last = ev.path_metrics(path, guess, last_only=True).select("symbol", C("mse").alias("last_mse"))
    return ev.path_metrics(path, guess).join(last, "symbol")




# ------------------------------------------------------------ Spark ML
def _lagged_levels(spark, sf):
    a = Axis()
    b = fx.levels(spark, sf)
    b = b.select("symbol", "ts", (C("close") / 1000).alias("target"), (a.lag("close") / 1000).alias("x"))
    return settle(b.filter(C("x").isNotNull()))


_XY = f"{LEVELS}, xy AS MATERIALIZED (SELECT * FROM (SELECT symbol, ts, close / 1000 AS y, lag(close) OVER w / 1000 AS x FROM levels {wins()}) WHERE x IS NOT NULL)"


def _linear_rows(spark, sf, penalty, degree=1):
    data = _lagged_levels(spark, sf)
    model = ml.fit_linear(data, ["x"], "target", penalty, degree=degree)
    return ml.predict(model, data)


@query("ml_linear", Shape(["symbol"], ["ts"], [], [], ["prediction"]), f"{_XY}, g AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM xy), res AS (SELECT symbol, ts, a + b * x AS prediction FROM xy, g)")
def ml_linear(spark, sf):
    return _linear_rows(spark, sf, "none")


@query(
    "ml_ridge",
    Shape(["symbol"], ["ts"], [], [], ["prediction"]),
    f"""{_XY}, g AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM xy),
res AS (SELECT symbol, ts, my + sxy / (sxx + 1) * (x - mx) AS prediction FROM xy, g)""",
)
def ml_ridge(spark, sf):
    return _linear_rows(spark, sf, "ridge")


@query(
    "ml_lasso",
    Shape(["symbol"], ["ts"], [], [], [], [], ["prediction"]),
    f"""{_XY}, g AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v FROM xy),
res AS (SELECT symbol, ts, my + greatest(c - 1, 0) / v * (x - mx) AS prediction FROM xy, g)""",
)
def ml_lasso(spark, sf):
    return _linear_rows(spark, sf, "lasso")


@query(
    "ml_elastic",
    Shape(["symbol"], ["ts"], [], [], [], [], ["prediction"]),
    f"""{_XY}, g AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v FROM xy),
res AS (SELECT symbol, ts, my + sign(c) * greatest(abs(c) - 0.5, 0) / (v + 0.5) * (x - mx) AS prediction FROM xy, g)""",
)
def ml_elastic(spark, sf):
    return _linear_rows(spark, sf, "elastic")


@query(
    "ml_polynomial",
    Shape(["symbol"], ["ts"], [], [], [], [], ["prediction"]),
    f"""{_XY}, g AS (SELECT count(*) AS n, avg(y) AS my, avg(x) AS m1, avg(x * x) AS m2, var_pop(x) * count(*) + 1 AS a, var_pop(x * x) * count(*) + 1 AS b,
  covar_pop(x, x * x) * count(*) AS c, covar_pop(x, y) * count(*) AS p, covar_pop(x * x, y) * count(*) AS q FROM xy),
res AS (SELECT symbol, ts, my + ((b * p - c * q) * (x - m1) + (a * q - c * p) * (x * x - m2)) / (a * b - c * c) AS prediction FROM xy, g)""",
)
def ml_polynomial(spark, sf):
    return _linear_rows(spark, sf, "ridge", degree=2)


@query(
    "feature_scaling",
    Shape(["symbol"], ["ts"], [], ["standard", "minmax", "robust"]),
    f"""{BARS},
s AS (SELECT avg(close) AS m, stddev_pop(close) AS sd, min(volume) AS lo, max(volume) AS hi, quantile_cont(open, 0.5) AS q2, quantile_cont(open, 0.75) - quantile_cont(open, 0.25) AS iqr FROM bars),
res AS (SELECT symbol, ts, (close - m) / sd AS standard, (volume - lo) / (hi - lo) AS minmax, (open - q2) / iqr AS robust FROM bars, s)""",
)
def feature_scaling(spark, sf):
    b = written(fx.bars(spark, sf))  # read by six passes
    scaler = ml.fit_scaler(b, ["close"]) | ml.fit_scaler(b, ["volume"], "minmax") | ml.fit_scaler(b, ["open"], "robust")
    return ml.scale(b, scaler).select("symbol", "ts", C("close").alias("standard"), C("volume").alias("minmax"), C("open").alias("robust"))


def _model_frame(spark, sf):
    """Features over the levels. Only the seven columns under them are written: the frame of some 200 is worked out again, without
    the columns nobody asks for, by each pass that reads it, which is far less than to store and read it."""
    levels = fx.levels(spark, sf).join(fx.bars(spark, sf, fx.SORTED_AGAIN).drop("close", "open"), ["symbol", "ts"])
    levels = written(levels.select("symbol", "ts", C("close").alias("open"), "high", "low", "close", "volume"))
    return ml.model_frame(levels).filter(C("target").isNotNull())


def _model_data(spark, sf):
    """(frame with the 50 best of all numeric features, imputed; their names)."""
    frame = _model_frame(spark, sf)
    chosen = ml.select_features(frame, ml.feature_columns(frame))
    return written(ml.impute(frame.select("symbol", "ts", "target", *chosen), chosen)), chosen


def _feature_sql() -> str:
    """Squared correlations of every feature of the model frame, put together from the twins of the indicator families.

    Each family's twin runs inside a CTE of its own, over the model frame's bars instead of its own.
    """
    families = "sma_features wma ema_macd rsi bollinger stoch_willr_cci volume_indicators price_momentum model_lag_features".split()
    parts, columns = [], {c: f"m.{c}" for c in _PRICES}
    for i, name in enumerate(families):
        q = REGISTRY[name]
        body = q.body().replace(fx.BARS_SQL.strip(), "bars AS (SELECT symbol, ts, open, high, low, close, volume FROM mf)", 1)
        parts.append(f"f{i} AS MATERIALIZED (WITH RECURSIVE {body} SELECT * FROM res)")
        columns |= {c: f"f{i}.{c}" for c in (*q.shape.plain, *q.shape.fine, *q.shape.coarse)}
    bands = f"f{families.index('bollinger')}"
    columns |= {"BB_lower_20_1_0": f"2 * {bands}.BB_middle_20 - {bands}.BB_upper_20_1_0", "BB_upper_20_2_5": f"2 * {bands}.BB_middle_20 - {bands}.BB_lower_20_2_5"}
    nr = list(enumerate(columns))
    joins = " ".join(f"JOIN f{i} ON f{i}.symbol = m.symbol AND f{i}.ts = m.ts" for i in range(len(families)))
    whole = " AND ".join(f"(c{i} IS NOT NULL OR NOT k{i})" for i, _ in nr)
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN x{i} * y > 0 THEN a{i} * a{i} / (x{i} * y) ELSE 0 END AS score FROM cr WHERE k{i}" for i, c in nr)
    return f"""{LEVELS},
mf AS MATERIALIZED (SELECT b.symbol, b.ts, l.close AS open, b.high, b.low, l.close, b.volume, lead(l.close) OVER (PARTITION BY b.symbol ORDER BY b.ts) / l.close - 1 AS target
  FROM bars b JOIN levels l ON l.symbol = b.symbol AND l.ts = b.ts),
{", ".join(parts)},
fr AS MATERIALIZED (SELECT m.target, {", ".join(f"CAST({columns[c]} AS DOUBLE) AS c{i}" for i, c in nr)} FROM mf m {joins} WHERE m.target IS NOT NULL),
st AS MATERIALIZED (SELECT {", ".join(f"1 - count(c{i}) / count(*) < 0.3 AND min(c{i}) < max(c{i}) AS k{i}" for i, _ in nr)} FROM fr),
cr AS MATERIALIZED (SELECT var_samp(target) AS y, {", ".join(f"any_value(k{i}) AS k{i}, covar_samp(c{i}, target) AS a{i}, var_samp(c{i}) AS x{i}" for i, _ in nr)} FROM fr, st WHERE {whole}),
res AS (SELECT * FROM ({rows}) ORDER BY round(score, 9) DESC, feature LIMIT 50)"""


@query("ml_feature_selection", Shape(["feature"], [], [], ["score"]), _feature_sql())
def ml_feature_selection(spark, sf):
    frame = _model_frame(spark, sf)
    return spark.createDataFrame(ml.feature_scores(frame, ml.feature_columns(frame))[:50], "feature string, score double")


@query("ml_forest", Shape(["symbol"], ["ts"], [], ["prediction"]))
def ml_forest(spark, sf):
    data, features = _model_data(spark, sf)
    cut = ml.time_folds(data, 4)[-1][0]
    train = data.filter(C("ts") < F.lit(cut))
    best = ml.grid_search(train, ml.fit_forest, None, features)[0]
    best.pop("rmse")
    return ml.predict(ml.fit_forest(train, features, **best), data.filter(C("ts") >= F.lit(cut)))


@query("ml_ensemble", Shape(["symbol"], ["ts"], [], ["prediction", "prediction_ridge", "prediction_forest", "prediction_boosted"]))
def ml_ensemble(spark, sf):
    data, features = _model_data(spark, sf)
    cut = ml.time_folds(data, 4)[-1][0]
    models = ml.fit_ensemble(data.filter(C("ts") < F.lit(cut)), features)
    return ml.predict_ensemble(models, data.filter(C("ts") >= F.lit(cut)))


# ------------------------------------------------------------ the merged dataset
def _supplier_news(spark, sf):
    """Scored items per supplier from line items: one per line, discount as mood."""
    return fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (F.round(C("l_discount") * 100) * 20 - 100).alias("sentiment_score"),
        "l_orderkey",
    )


_SERIES = ("DISC", "TAX", "QTY")
_LAGGED = ("u_returns", "close", "sentiment_score", "u_rsi")
_U_FINE = ["u_returns", "u_log_returns", "u_bb_position", "u_rsi", "u_volume_ratio", *[f"u_sma_{n}_ratio" for n in (5, 10, 20, 50, 200)]]
_U_COARSE = [
    *[f"u_sma_{n}" for n in (5, 10, 20, 50, 200)], "u_ema_12", "u_ema_26", "u_macd", "u_macd_signal", "u_macd_diff", "u_bb_middle", "u_bb_upper", "u_bb_lower",
    "u_bb_width", "u_volume_sma_10", "u_price_volume",
]
_REGIME = ["volatility_20d", "volatility_60d", "volatility_ratio", "trend_strength"]
_CALENDAR = [
    "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year", "is_monday", "is_friday", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end",
]
_MOOD = ["sentiment_score", "sentiment_ma_3d", "sentiment_ma_7d", "sentiment_volatility", "sentiment_momentum"]
_BEFORE = [*_U_FINE, *_U_COARSE, *_REGIME, *_MOOD, *_SERIES]  # what may be missing in a row; 63 columns stand before the counts
_LAGS = (1, 2, 3, 5, 10)
_U_PLAIN = [*[f"{s}_days_since_update" for s in _SERIES], *_CALENDAR, "high_volatility", "missing_count"]
_U_SIX = [*_U_FINE, *_REGIME, *_SERIES, "missing_pct", *[f"{c}_lag_{k}" for c in ("u_returns", "u_rsi") for k in _LAGS]]
_U_FOUR = [*_PRICES, *_U_COARSE, *_MOOD, "sentiment_age_hours", *[f"{c}_lag_{k}" for c in ("close", "sentiment_score") for k in _LAGS]]
_UNIFIED = f"""{_unified_sql.replace("res AS (", "uind AS MATERIALIZED (")},
{_regime_sql.strip().replace("res AS (", "ureg AS MATERIALIZED (")},{fx.macro_sql()},
sn AS (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ts, avg(round(l_discount * 100) * 20 - 100) AS sentiment_score FROM lineitem GROUP BY 1, 2),
{", ".join(f"m_{s} AS (SELECT date, value FROM macro WHERE series_id = '{s}')" for s in _SERIES)},
um0 AS (SELECT b.symbol, b.ts, s.sentiment_score, {", ".join(f"m_{s}.value AS {s}, CAST(date_diff('day', m_{s}.date, b.ts) AS INTEGER) AS {s}_days_since_update" for s in _SERIES)}
  FROM bars b {" ".join(f"ASOF LEFT JOIN m_{s} ON b.ts >= m_{s}.date" for s in _SERIES)} LEFT JOIN sn s ON s.symbol = b.symbol AND s.ts = b.ts),
um1 AS (SELECT *, CASE WHEN count(sentiment_score) OVER w3 = 3 THEN avg(sentiment_score) OVER w3 END AS sentiment_ma_3d,
  CASE WHEN count(sentiment_score) OVER w7 = 7 THEN avg(sentiment_score) OVER w7 END AS sentiment_ma_7d,
  CASE WHEN count(sentiment_score) OVER w7 = 7 THEN stddev_samp(sentiment_score) OVER w7 END AS sentiment_volatility, 0.0 AS sentiment_age_hours FROM um0 {wins(3, 7)}),
ua AS (SELECT b.*, {CALENDAR_SQL.replace("(ts", "(b.ts").replace("'quarter', ts", "'quarter', b.ts")}, m.* EXCLUDE (symbol, ts), m.sentiment_score - m.sentiment_ma_7d AS sentiment_momentum,
  {", ".join(f"i.{c}" for c in [*_U_FINE, *_U_COARSE])}, {", ".join(f"r.{c}" for c in [*_REGIME, "high_volatility"])}
  FROM bars b JOIN um1 m ON m.symbol = b.symbol AND m.ts = b.ts JOIN uind i ON i.symbol = b.symbol AND i.ts = b.ts JOIN ureg r ON r.symbol = b.symbol AND r.ts = b.ts),
ub AS (SELECT *, {" + ".join(f"({c} IS NULL)::INT" for c in _BEFORE)} AS missing_count FROM ua),
ures AS MATERIALIZED (SELECT *, missing_count / 63.0 AS missing_pct, {", ".join(f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for c in _LAGGED for k in _LAGS)} FROM ub {wins()})"""


def _unified(spark, sf, **kw):
    return un.unified_dataset(fx.bars(spark, sf), fx.macro(spark, sf), list(_SERIES), _supplier_news(spark, sf), tie=["l_orderkey"], **kw)


@query("unified_dataset", Shape(["symbol"], ["ts"], _U_PLAIN, _U_SIX, _U_FOUR), f"{_UNIFIED}, res AS (SELECT * FROM ures)")
def unified(spark, sf):
    """All 84 columns of the merged dataset, with three macro series."""
    return _unified(spark, sf)[0]


_U_ALL = [*_U_PLAIN, *_U_SIX, *_U_FOUR]
_UNIFIED_REPORT = f"""{_UNIFIED},
ul AS MATERIALIZED (UNPIVOT (SELECT symbol, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _U_ALL)} FROM ures) ON COLUMNS(* EXCLUDE (symbol)) INTO NAME col VALUE v),
un AS (SELECT symbol, count(*) AS n FROM ures GROUP BY 1),
uq AS (SELECT symbol, col, count(*) AS known, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM ul GROUP BY 1, 2),
uo AS (SELECT ul.symbol, ul.col, any_value(known) AS known, any_value(q3 - q1) AS iqr, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS k
  FROM ul JOIN uq ON uq.symbol = ul.symbol AND uq.col = ul.col GROUP BY 1, 2),
us AS (SELECT symbol, date_diff('day', lag(ts) OVER w, ts) AS step FROM ures {wins()}),
uc AS (SELECT symbol, step, count(*) AS k FROM us WHERE step IS NOT NULL GROUP BY 1, 2),
ue AS (SELECT *, first_value(step) OVER (PARTITION BY symbol ORDER BY k DESC, step) AS expected FROM uc),
ug AS (SELECT symbol, coalesce(sum(k) FILTER (WHERE step > expected * 1.5), 0) AS gap_count FROM ue GROUP BY 1),
ui AS (
  SELECT symbol, 'WARNING' AS severity FROM un WHERE n < 10 UNION ALL
  SELECT symbol, 'INFO' FROM un UNION ALL
  SELECT symbol, 'WARNING' FROM ug WHERE gap_count > 0 UNION ALL
  SELECT symbol, CASE WHEN (n - known) / n * 100 > 50 THEN 'ERROR' ELSE 'WARNING' END FROM uq JOIN un USING (symbol) WHERE (n - known) / n * 100 > 10 UNION ALL
  SELECT symbol, CASE WHEN k / known * 100 > 25 THEN 'ERROR' WHEN k / known * 100 > 10 THEN 'WARNING' ELSE 'INFO' END FROM uo WHERE known > 10 AND iqr > 0 AND k > 0),
uk AS (SELECT symbol, {", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}_issues" for s in ("CRITICAL", "ERROR", "WARNING", "INFO"))} FROM ui GROUP BY 1),
ux AS (SELECT symbol, sum(known) AS known FROM uq GROUP BY 1),
uz AS (SELECT un.symbol, n AS rows, (n * {len(_U_ALL)} - known) / (n * {len(_U_ALL)}.0) * 100 AS missing_pct, uk.* EXCLUDE (symbol) FROM un JOIN ux USING (symbol) JOIN uk USING (symbol)),
res AS (SELECT *, greatest(0, 100 - 25 * critical_issues - 10 * error_issues - 5 * warning_issues - info_issues - 0.5 * missing_pct) AS quality_score,
  critical_issues = 0 AS is_valid FROM uz)"""


@query("unified_report", Shape(["symbol"], [], ["rows", "error_issues", "warning_issues", "info_issues", "is_valid"], ["missing_pct", "quality_score"]), _UNIFIED_REPORT)
def unified_report(spark, sf):
    return _unified(spark, sf, now="2030-01-01", report=True)[2]
