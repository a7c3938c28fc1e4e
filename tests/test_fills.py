"""Fills and squeezes on the order at hand: one sort, no map per row."""

import datetime as dt

from pyspark.sql import functions as F

from panelmill.functions.axis import DAILY
from panelmill.functions.rolling import quantile_of_sorted
from panelmill.operators import clean, indicators, ml


def _rows(spark):
    gap = [None, None, 1.0, None, 3.0, None]
    rows = [(k, dt.date(2024, 1, i + 1), a if k == "A" else None, b) for k in "AB" for i, (a, b) in enumerate(zip(gap, reversed(gap), strict=True))]
    return spark.createDataFrame(rows, "symbol string, ts date, a double, b double")


def test_fill_both_ways_on_one_sort(spark):
    df = _rows(spark)
    got, want = clean.fill_both(df, ["a", "b"]), clean.back_fill(clean.forward_fill(df, ["a", "b"]), ["a", "b"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _sorts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Sort [")


def test_impute_sorts_once(spark):
    df = ml.impute(_rows(spark), ["a", "b"])
    assert _sorts(df) == 1
    assert df.filter("symbol = 'A'").count() == 6 and df.filter("symbol = 'B'").count() == 0


def test_filled_indicators_sort_once(spark, sf):
    from panelmill.plans import fixtures as fx

    df = indicators.technical_indicators(_bars(fx.bars(spark, sf)), fill="reference")
    assert _sorts(df) == 1


def _bars(bars):
    return bars.sparkSession.createDataFrame([], bars.schema)


def test_squeeze_keeps_no_map_per_row(spark, sf):
    from panelmill.plans import fixtures as fx

    bars = fx.bars(spark, sf)
    made = indicators.add_bollinger(bars)
    assert "percentile(" not in made._jdf.queryExecution().executedPlan().toString()
    w = DAILY.last(50)
    wide = "BB_width_normalized_20"
    old = F.when(F.count(wide).over(w) == 50, F.percentile(wide, F.lit(0.2)).over(w))
    both = made.withColumns({"old": F.coalesce(F.col(wide) < old, F.lit(False)).cast("int"), "new": F.col("BB_squeeze_20").cast("int")})
    assert both.filter("old <> new").count() == 0 and both.filter("new = 1").count() > 0
    frames = spark.createDataFrame([([float(i * i % 17) / 3 for i in range(50)],), ([2.5] * 50,)], "v array<double>").withColumn("i", F.monotonically_increasing_id())
    want = {r["i"]: r["p"] for r in frames.select("i", F.explode("v").alias("x")).groupBy("i").agg(F.percentile("x", F.lit(0.2)).alias("p")).collect()}
    assert {r["i"]: r["q"] for r in frames.select("i", quantile_of_sorted(F.sort_array("v"), 50, 0.2).alias("q")).collect()} == want
