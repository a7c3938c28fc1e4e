"""Forecast evaluation: metrics, alignment, folds, tests, rankings."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axis import DAILY, Axis
from ..functions.exprs import sign, total

C = F.col


def _corr(a: Column, b: Column) -> Column:
    """Correlation of complete pairs; 0 when a side is constant."""
    ok = a.isNotNull() & b.isNotNull()
    x, y = F.when(ok, a), F.when(ok, b)
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    return F.when(flat, 0.0).otherwise(F.coalesce(r, F.lit(0.0)))


def _smape(a: Column, p: Column, floor: float = 1e-8) -> Column:
    return F.avg(F.abs(a - p) / F.greatest((F.abs(a) + F.abs(p)) / 2, F.lit(floor))) * 100


def forecast_metrics(df: DataFrame, by: Sequence[str] = ("symbol", "model"), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Error, direction, correlation and bias figures per group, in one aggregate."""
    a, p = C(actual), C(predicted)
    df = df.filter(a.isNotNull() & p.isNotNull())
    return df.groupBy(*by).agg(
        F.avg((a - p) * (a - p)).alias("mse"),
        F.avg(F.abs(a - p)).alias("mae"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        _smape(a, p).alias("smape"),
        (F.avg(((a > 0) == (p > 0)).cast("double")) * 100).alias("direction_accuracy"),
        _corr(a, p).alias("correlation"),
        F.avg(a).alias("mean_actual"),
        F.avg(p).alias("mean_predicted"),
        F.stddev_pop(a).alias("std_actual"),
        F.stddev_pop(p).alias("std_predicted"),
        (F.avg(p) - F.avg(a)).alias("prediction_bias"),
        F.count(F.lit(1)).alias("num_samples"),
    )


def regression_metrics(df: DataFrame, by: Sequence[str] = (), actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """mse, rmse, mae, r2 and smape with a 1e-8 guard in the denominator."""
    a, p = C(actual), C(predicted)
    df = df.filter(a.isNotNull() & p.isNotNull())
    aggs = [
        F.avg((a - p) * (a - p)).alias("mse"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.avg(F.abs(a - p)).alias("mae"),
        (1 - F.try_divide(F.sum((a - p) * (a - p)), F.var_pop(a) * F.count(a))).alias("r2"),
        (F.avg(F.abs(a - p) * 2 / (F.abs(a) + F.abs(p) + 1e-8)) * 100).alias("smape"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def lag_scan(df: DataFrame, axis: Axis = Axis(key=("symbol", "model")), lags: Sequence[int] = range(-3, 4), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Correlation of actual[t] with predicted[t + lag] per group and lag; all lags in one pass."""
    df = df.filter(C(actual).isNotNull() & C(predicted).isNotNull())
    shifted = {f"_p{i}": (C(predicted) if k == 0 else axis.lead(predicted, k) if k > 0 else axis.lag(predicted, -k)) for i, k in enumerate(lags)}
    wide = df.withColumns(shifted)
    sums = wide.groupBy(*axis.key).agg(*[_corr(C(actual), C(f"_p{i}")).alias(f"_c{i}") for i in range(len(lags))])
    return sums.select(*axis.key, F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), C(f"_c{i}").alias("correlation")) for i, k in enumerate(lags)])))


def best_lag(scan: DataFrame, key: Sequence[str] = ("symbol", "model"), threshold: float = 0.1) -> DataFrame:
    """Lag of the strongest correlation (the smallest lag on ties) and whether it points to a shift."""
    out = scan.groupBy(*key).agg(
        F.min_by(F.struct("lag", "correlation"), F.struct(-F.round(F.abs("correlation"), 12), C("lag"))).alias("b"),
        F.max(F.when(C("lag") == 0, C("correlation"))).alias("at_zero"),
    )
    lag, corr = C("b.lag"), C("b.correlation")
    return out.select(
        *key,
        lag.alias("best_lag"),
        corr.alias("best_correlation"),
        C("at_zero").alias("correlation"),
        ((F.abs(corr) > threshold) & (lag != 0)).alias("alignment_warning"),
        ((lag != 0) & (F.abs(corr) > F.abs("at_zero"))).alias("alignment_issue"),
    )


def assign_folds(df: DataFrame, axis: Axis, folds: int = 5, size: int = 30, min_context: int = 60) -> DataFrame:
    """Give the last ``folds*size`` rows of every series a fold number; earlier rows are context.

    Series too short for all folds use as many as fit after the context.
    """
    newest = Window.partitionBy(*axis.key).orderBy(*[F.desc(c) for c in axis.order])
    rows = F.count(F.lit(1)).over(Window.partitionBy(*axis.key))
    n = df.withColumns({"_back": F.row_number().over(newest), "_n": rows})
    fit = F.when(C("_n") >= folds * size + min_context, folds).otherwise(F.greatest(F.lit(1), F.floor((C("_n") - min_context) / size)))
    n = n.withColumn("_k", fit).withColumn("fold", (C("_k") - 1 - F.floor((C("_back") - 1) / size)).cast("int"))
    start = C("_n") - (C("_k") - C("fold")) * size
    return n.filter((C("fold") >= 0) & (start >= min_context)).drop("_back", "_n", "_k")


def rolling_evaluation(df: DataFrame, axis: Axis = Axis(key=("symbol", "model")), folds: int = 5, size: int = 30, min_context: int = 60) -> DataFrame:
    """Metrics per fold."""
    return forecast_metrics(assign_folds(df, axis, folds, size, min_context), by=(*axis.key, "fold"))


FOLD_METRICS = ("mse", "mae", "rmse", "smape", "direction_accuracy", "correlation")


def fold_summary(folds: DataFrame, by: Sequence[str] = ("symbol", "model"), names: Sequence[str] = FOLD_METRICS) -> DataFrame:
    """Mean, population deviation, min and max of each metric over the folds."""
    aggs = []
    for m in names:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return folds.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("folds"), F.sum("num_samples").alias("total_samples"))


# ------------------------------------------------------------ paired test


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t, of plain numbers; ``two_sided_p`` is the column."""
    x = dof / (dof + t * t)
    a, b = dof / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def log_gamma(z: Column) -> Column:
    """ln Gamma(z) for z > 0: eight steps up, then Stirling's series."""
    up = z + 8
    series = 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5) - 1 / (1680 * up**7) + 1 / (1188 * up**9)
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - total([F.log(z + i) for i in range(8)])


def _fraction(a: Column, b: Column, x: Column, steps: int) -> Column:
    """Continued fraction of the incomplete beta function, folded from its far end inwards."""

    def even(m: Column) -> Column:
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    def odd(m: Column) -> Column:
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    # 1 + d1 / (1 + d2 / (1 + ...)) with d1 = odd(0), d2 = even(1), d3 = odd(1) ...
    inner = F.aggregate(F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), F.lit(1.0), lambda acc, m: 1 + even(m.cast("double")) / (1 + odd(m.cast("double")) / acc))
    return 1 / (1 + odd(F.lit(0.0)) / inner)


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 400) -> Column:
    """Regularised incomplete beta function I_x(a, b) as a column; the side on which the fraction converges fast is taken."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    near = front / a * _fraction(a, b, x, steps)
    far = 1 - front / b * _fraction(b, a, 1 - x, steps)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), near).otherwise(far)


def two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t; NULL without a statistic or with fewer than one degree of freedom."""
    n = dof.cast("double")
    return F.when(t.isNotNull() & (n >= 1), incomplete_beta(n / 2, F.lit(0.5), n / (n + t * t)))


def paired_t(
    df: DataFrame, models: Sequence[str], axis: Axis = DAILY, model: str = "model", actual: str = "actual", predicted: str = "predicted", points: int | None = None
) -> DataFrame:
    """Paired t-test of absolute errors for every pair of the listed models, per series.

    Errors of one time are brought side by side by a pivot, so pairs are
    columns, not joined rows.  ``points`` limits the test to the first rows of
    a series, as a stored evaluation sample would.
    """
    err = F.abs(C(actual) - C(predicted))
    rows = df.withColumn("_e", err).filter(C("_e").isNotNull())
    wide = rows.groupBy(*axis.key, axis.ts).pivot(model, list(models)).agg(F.first("_e"))
    if points is not None:
        wide = wide.withColumn("_rn", F.row_number().over(axis.by_time())).filter(C("_rn") <= points)
    pairs = list(itertools.combinations(models, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        d = C(f"`{a}`") - C(f"`{b}`")
        both = C(f"`{a}`").isNotNull() & C(f"`{b}`").isNotNull()
        aggs += [
            F.avg(d).alias(f"_m{i}"), F.stddev_samp(d).alias(f"_s{i}"), F.count(d).alias(f"_n{i}"),
            F.avg(F.when(both, C(f"`{a}`"))).alias(f"_a{i}"), F.avg(F.when(both, C(f"`{b}`"))).alias(f"_b{i}"),
        ]
    agg = wide.groupBy(*axis.key).agg(*aggs)
    structs = [
        F.struct(
            F.lit(a).alias("model_a"),
            F.lit(b).alias("model_b"),
            F.try_divide(C(f"_m{i}"), C(f"_s{i}") / F.sqrt(C(f"_n{i}"))).alias("t_statistic"),
            C(f"_n{i}").alias("n"),
            C(f"_a{i}").alias("mean_error_a"),
            C(f"_b{i}").alias("mean_error_b"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    out = agg.select(*axis.key, F.inline(F.array(*structs)))
    out = out.withColumn("p_value", two_sided_p(C("t_statistic"), C("n") - 1))
    return out.withColumn("significant", F.coalesce(C("p_value") < 0.05, F.lit(False)))


# ------------------------------------------------------------ ranking


def rank_models(metrics: DataFrame, by: Sequence[str] = ("symbol",), score: str = "smape") -> DataFrame:
    """Rank 1..n per group, best score first; the model name settles ties."""
    w = Window.partitionBy(*by).orderBy(C(score).asc_nulls_last(), "model")
    return metrics.withColumn("rank", F.row_number().over(w))


def top_models(metrics: DataFrame, n: int = 5, score: str = "smape") -> DataFrame:
    return metrics.orderBy(C(score).asc_nulls_last(), "symbol", "model").limit(n)


def leaderboard(metrics: DataFrame, score: str = "smape_mean") -> DataFrame:
    return metrics.groupBy("model").agg(F.avg(score).alias(score), F.count(F.lit(1)).alias("series")).orderBy(C(score).asc_nulls_last(), "model")


def run_leaderboard(metrics: DataFrame, timings: DataFrame, n: int = 5, score: str = "smape") -> DataFrame:
    """Best runs over all symbols with their training time."""
    return top_models(metrics.join(timings, ["symbol", "model"], "left"), n, score)


def training_summary(runs: DataFrame, model: str = "model", ok: str = "succeeded") -> DataFrame:
    """Attempts and successes per model family (name up to the first '_') and over all."""
    fam = runs.select(F.split(model, "_")[0].alias("family"), C(ok).alias("_ok"))
    rows = lambda df: df.agg(F.count(F.lit(1)).alias("attempted"), F.count_if("_ok").alias("succeeded"))
    out = rows(fam.groupBy("family")).unionByName(rows(fam.groupBy(F.lit("ALL").alias("family"))))
    return out.withColumn("success_rate", C("succeeded") / C("attempted") * 100)


def success_criteria(metrics: DataFrame) -> DataFrame:
    """Targets smape < 50, direction >= 55, correlation >= 0.3, and a 0-100 closeness score."""
    s, d, c = C("smape"), C("direction_accuracy"), C("correlation")
    # The targets, weights and scales below
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    score = (0.5 * clip((200 - s) / 150) + 0.3 * clip(d / 60) + 0.2 * clip((c + 1) / 1.3)) * 100
    return metrics.withColumns(
        {
            "smape_target": s < 50,
            "direction_target": d >= 55,
            "correlation_target": c >= 0.3,
            "overall_success": (s < 50) & (d >= 55) & (c >= 0.3),
            "improvement_score": F.round(score, 1),
        }
    )


# ------------------------------------------------------------ paths and prices


def price_metrics(df: DataFrame, axis: Axis = Axis(key=("symbol", "model")), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Price-level errors, and agreement of the step directions."""
    a, p = C(actual), C(predicted)
    steps = df.withColumns({"_da": axis.diff(actual), "_dp": axis.diff(predicted)})
    same = F.when(C("_da").isNotNull(), (sign("_da") == sign("_dp")).cast("double"))
    return steps.groupBy(*axis.key).agg(
        F.avg((a - p) * (a - p)).alias("mse"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.avg(F.abs(a - p)).alias("mae"),
        _smape(a, p).alias("smape"),
        (F.avg(same) * 100).alias("direction_accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def holdout_path(bars: DataFrame, horizon: int, axis: Axis = DAILY, price: str = "close") -> DataFrame:
    """The last ``horizon`` rows of every series as returns on the price just before them, by step."""
    newest = Window.partitionBy(*axis.key).orderBy(*[F.desc(c) for c in axis.order])
    n = bars.select(*axis.key, *axis.order, price).withColumn("_back", F.row_number().over(newest))
    n = n.filter(C("_back") <= horizon + 1)
    base = F.max(F.when(C("_back") == horizon + 1, C(price))).over(Window.partitionBy(*axis.key))
    out = n.withColumn("_base", base).filter((C("_back") <= horizon) & C("_base").isNotNull())
    return out.select(*axis.key, *axis.order, (horizon + 1 - C("_back")).alias("step"), (C(price) / C("_base") - 1).alias("actual"))


def path_metrics(path: DataFrame, predicted: DataFrame, key: Sequence[str] = ("symbol",), last_only: bool = False) -> DataFrame:
    """mse and rmse of predicted paths (symbol, step, predicted) against the held-out path."""
    both = path.join(predicted, [*key, "step"])
    if last_only:
        both = both.withColumn("_top", F.max("step").over(Window.partitionBy(*key))).filter(C("step") == C("_top"))
    e = C("actual") - C("predicted")
    return both.groupBy(*key).agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))
