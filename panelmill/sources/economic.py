"""Macro series: parsing, lookup, wide form, runs, yield curve, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis, Scan, apply_waves, running
from ..functions.rolling import rolling_correlation

C = F.col

# Series codes of the configured indicators and their names.
INDICATORS = {
    "DGS10": "10-Year Treasury Rate",
    "DEXUSEU": "USD/EUR Exchange Rate",
    "DFF": "Federal Funds Rate",
    "UNRATE": "Unemployment Rate",
    "CPIAUCSL": "Consumer Price Index",
    "GDPC1": "Real GDP",
    "DCOILWTICO": "Crude Oil Prices WTI",
    "VIXCLS": "VIX Volatility Index",
}

# Maturity in months of each constant-maturity series.
MATURITIES = {
    "DGS1MO": 1, "DGS3MO": 3, "DGS6MO": 6, "DGS1": 12, "DGS2": 24, "DGS3": 36,
    "DGS5": 60, "DGS7": 84, "DGS10": 120, "DGS20": 240, "DGS30": 360,
}

OBSERVATIONS = "struct<observations: array<struct<date: string, value: string>>>"


def parse_observations(df: DataFrame, payload: str = "payload", series_id: str = "series_id") -> DataFrame:
    """JSON payloads to (series_id, date, value); entries that are not numbers are dropped."""
    rows = df.select(C(series_id).alias("series_id"), F.explode(F.from_json(payload, OBSERVATIONS)["observations"]).alias("o"))
    out = rows.select("series_id", F.expr("try_cast(o.date AS date)").alias("date"), F.expr("try_cast(o.value AS double)").alias("value"))
    return out.filter(C("value").isNotNull() & ~F.isnan("value") & C("date").isNotNull())


def resolve_indicator(names: DataFrame, name: str = "name", catalogue: dict[str, str] | None = None) -> DataFrame:
    """Indicator names (any case) to series codes; unknown names are taken as codes."""
    items = [x for code, label in (catalogue or INDICATORS).items() for x in (F.lit(label.lower()), F.lit(code))]
    return names.withColumn("series_id", F.coalesce(F.element_at(F.create_map(*items), F.lower(name)), C(name)))


def macro_wide(macro: DataFrame, series: Sequence[str], fill: bool = True) -> DataFrame:
    """One row per date, one column per series, gaps carried forward.

    A single shuffle by date; the fill orders at most one row per calendar day.
    """
    wide = macro.filter(C("series_id").isin(*series)).groupBy("date").pivot("series_id", list(series)).agg(F.first("value"))
    if not fill:
        return wide
    axis = Axis(key=("_all",), ts="date")
    return running(wide.withColumn("_all", F.lit(1)), axis, {s: Scan("last", C(s)) for s in series}).drop("_all")


def search_series(catalogue: DataFrame, text: str, limit: int = 10, title: str = "title") -> DataFrame:
    """Catalogue rows whose title holds the text, in id order."""
    return catalogue.filter(F.lower(title).contains(text.lower())).orderBy("series_id").limit(limit)


def series_info(catalogue: DataFrame, series_id: str) -> DataFrame:
    return catalogue.filter(C("series_id") == series_id)


def recession_runs(flags: DataFrame, key: Sequence[str] = (), date: str = "date", flag: str = "flag") -> DataFrame:
    """Runs of flag = 1: first day, first later day with 0, length in days; a run still open is left out."""
    keys = list(key) or ["_all"]
    df = flags if key else flags.withColumn("_all", F.lit(1))
    axis = Axis(key=tuple(keys), ts=date)
    df = df.withColumn("_start", ((C(flag) == 1) & (F.coalesce(axis.lag(flag), F.lit(0)) != 1)).cast("int"))
    df = running(df, axis, {"_run": Scan("sum", C("_start")), "_next0": Scan("next", F.when(C(flag) != 1, C(date)))})
    runs = df.filter(C(flag) == 1).groupBy(*keys, "_run").agg(F.min(date).alias("start"), F.max("_next0").alias("end"))
    closed = runs.filter(C("end").isNotNull())
    return closed.select(*key, "start", "end", F.datediff("end", "start").alias("duration_days"))


def yield_curve(macro: DataFrame, day, maturities: dict[str, int] | None = None) -> DataFrame:
    """Last value of each maturity on or before ``day``; maturity in years."""
    months = maturities or MATURITIES
    lookup = F.create_map(*[x for k, v in months.items() for x in (F.lit(k), F.lit(v))])
    rows = macro.filter(C("series_id").isin(*months) & (C("date") <= F.lit(day).cast("date")))
    last = rows.groupBy("series_id").agg(F.max_by("value", "date").alias("yield"), F.max("date").alias("date"))
    return last.withColumn("maturity_years", F.element_at(lookup, C("series_id")) / 12).orderBy("maturity_years")


def indicator_correlation(df: DataFrame, a: str, b: str, axis: Axis, window: int = 252) -> DataFrame:
    """Per series: Pearson correlation, mean and deviation of the rolling correlation, row count."""
    both = df.filter(C(a).isNotNull() & C(b).isNotNull())
    rolled = apply_waves(both, axis, rolling_correlation(a, b, axis, window, "_rc"))
    corr = F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    return rolled.groupBy(*axis.key).agg(
        corr.alias("correlation"),
        F.avg("_rc").alias("rolling_mean"),
        F.stddev_samp("_rc").alias("rolling_std"),
        F.count(F.lit(1)).alias("observations"),
    )


