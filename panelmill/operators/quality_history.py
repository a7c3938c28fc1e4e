"""Quality runs over time: summaries, trends, recommendations, alerts.

A run is kept as one summary row plus its issue rows in a second table, so a
run over any number of datasets never becomes one wide record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

C = F.col

# Default alert limits.
LIMITS = {"min_pass_rate": 80.0, "min_quality_score": 70.0, "max_critical_issues": 0, "max_error_issues": 5}
# How often a category may occur in recent runs before advice is given.
ADVICE = (
    ("missing_data", 5, "collect data more robustly to reduce missing values"),
    ("outliers", 3, "detect and handle outliers in preprocessing"),
    ("business_logic", 2, "review and strengthen the business rules"),
    ("data_types", 2, "validate and convert data types automatically"),
)


def run_summary(reports: DataFrame, run_ts: Column | str = "run_ts", category: Column | str = "category") -> DataFrame:
    """One row per run and category from its dataset reports."""
    at = C(run_ts) if isinstance(run_ts, str) else run_ts
    cat = C(category) if isinstance(category, str) else category
    return reports.groupBy(at.alias("run_ts"), cat.alias("category")).agg(
        F.count(F.lit(1)).alias("total_datasets"),
        F.count_if("is_valid").alias("datasets_passed"),
        (F.count_if("is_valid") / F.count(F.lit(1)) * 100).alias("pass_rate"),
        F.avg("quality_score").alias("avg_quality_score"),
        F.sum("total_issues").alias("total_issues"),
        F.sum("critical_issues").alias("critical_issues"),
        F.sum("error_issues").alias("error_issues"),
        F.sum("warning_issues").alias("warning_issues"),
    )


def _trend(value: str, order: str = "_ix") -> Column:
    slope = F.regr_slope(C(value).cast("double"), C(order).cast("double"))
    return (
        F.when(F.count(value) < 2, "insufficient_data").when(slope > 0.1, "improving").when(slope < -0.1, "declining").otherwise("stable")
    )


def trends(runs: DataFrame, since=None, by_category: bool = False) -> DataFrame:
    """Means, sums and direction of the run summaries; runs are few, one row each."""
    if since is not None:
        runs = runs.filter(C("run_ts") >= F.lit(since).cast(runs.schema["run_ts"].dataType))
    keys = ["category"] if by_category else []
    order = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("run_ts", *([] if by_category else ["category"]))
    ranked = runs.withColumn("_ix", F.row_number().over(order))
    aggs = [
        F.count(F.lit(1)).alias("runs"),
        F.min("run_ts").alias("first_run"),
        F.max("run_ts").alias("last_run"),
        F.avg("pass_rate").alias("avg_pass_rate"),
        F.avg("avg_quality_score").alias("avg_quality_score"),
        F.sum("total_datasets").alias("datasets"),
        F.sum("total_issues").alias("issues"),
        *[F.sum(f"{s}_issues").alias(f"{s}_issues") for s in ("critical", "error", "warning")],
        *[F.avg(f"{s}_issues").alias(f"avg_{s}_issues") for s in ("critical", "error", "warning")],
        _trend("pass_rate").alias("pass_rate_trend"),
        _trend("avg_quality_score").alias("quality_score_trend"),
        _trend("total_issues").alias("issue_count_trend"),
    ]
    return ranked.groupBy(*keys).agg(*aggs)


def recent_runs(runs: DataFrame, last: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("run_ts"), "category").limit(last)


def recommendations(runs: DataFrame, issues: DataFrame, last: int = 10) -> DataFrame:
    """Advice from the issue categories and scores of the last runs."""
    recent = settle(recent_runs(runs, last))  # at most ``last`` rows, which three branches read
    hits = issues.join(recent.select("run_ts", C("category").alias("run_category")), ["run_ts", "run_category"], "left_semi")
    by_cat = settle(hits.groupBy("category").agg(F.count(F.lit(1)).alias("n")))
    advice = [F.when((C("category") == c) & (C("n") > k), F.lit(text)) for c, k, text in ADVICE]
    from_issues = by_cat.select(F.explode(F.array_compact(F.array(*advice))).alias("recommendation"))
    means = recent.agg(F.avg("pass_rate").alias("p"), F.avg("avg_quality_score").alias("q"))
    from_runs = means.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(C("p") < 80, F.lit("pass rate is below 80: review the validation thresholds")),
                    F.when(C("q") < 70, F.lit("quality score is below 70: tighten data quality controls")),
                )
            )
        ).alias("recommendation")
    )
    none = by_cat.agg(F.count(F.lit(1)).alias("k")).filter(C("k") == 0).select(F.lit("no issues in recent runs").alias("recommendation"))
    return from_issues.unionByName(from_runs).unionByName(none)


def alerts(runs: DataFrame, limits: dict | None = None) -> DataFrame:
    """Limit violations of the latest run."""
    lim = {**LIMITS, **(limits or {})}
    latest = runs.agg(F.max_by(F.struct(*runs.columns), F.struct("run_ts", "category")).alias("r")).select("r.*")
    hit = lambda cond, sev, kind, value: F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(kind).alias("type"), value.cast("double").alias("value")))
    found = F.array_compact(
        F.array(
            hit(C("pass_rate") < lim["min_pass_rate"], "warning", "low_pass_rate", C("pass_rate")),
            hit(C("avg_quality_score") < lim["min_quality_score"], "warning", "low_quality_score", C("avg_quality_score")),
            hit(C("critical_issues") > lim["max_critical_issues"], "critical", "critical_issues", C("critical_issues")),
            hit(C("error_issues") > lim["max_error_issues"], "error", "error_issues", C("error_issues")),
        )
    )
    return latest.select("run_ts", F.inline(found))


def operation_latency(log: DataFrame, operation: str = "operation", seconds: str = "seconds") -> DataFrame:
    """Count, total, mean, shortest and longest duration per logged operation."""
    s = C(seconds)
    return log.groupBy(operation).agg(
        F.count(s).alias("calls"), F.sum(s).alias("total_time"), F.avg(s).alias("avg_time"), F.min(s).alias("min_time"), F.max(s).alias("max_time")
    )
