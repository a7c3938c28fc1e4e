"""Frames put together from short ones: how far they slide, and what they give."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions.axis import DAILY, apply_waves
from panelmill.functions.rolling import _steps, chained_moments
from panelmill.operators import indicators as ind


def bars(spark, n=400):
    x = F.round(F.lit(50.0) + 9 * F.sin(F.col("id") * 1.7) + F.col("id") % 13)
    return spark.range(n).select(F.lit("A").alias("symbol"), F.expr("date'2024-01-01' + cast(id as int)").alias("ts"), x.alias("close"), (x * 3).alias("volume"))


@pytest.mark.parametrize("waves", [ind.market_regime, ind.unified_indicators])
def test_no_frame_slides_over_more_than_ten_rows(spark, waves):
    """A sliding frame is read again for every row; longer ones come from lags."""
    plan = apply_waves(bars(spark, 5), DAILY, waves())._jdf.queryExecution().optimizedPlan().toString()
    lengths = [int(n) + 1 for n in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+), currentrow\$\(\)\)", plan)]
    assert lengths and max(lengths) <= 10


def test_moments_of_three_sizes(spark):
    rows = bars(spark).withColumn("close", F.when(F.col("ts") != F.lit("2024-03-01").cast("date"), F.col("close")))
    sizes = {20: ("m20", "s20"), 60: ("m60", "s60")}
    got = apply_waves(rows, DAILY, chained_moments("close", DAILY, (5, 20, 60), sizes)).orderBy("ts").toPandas()
    for n, (mean, std) in sizes.items():
        want = got.close.astype(float).rolling(n)
        np.testing.assert_allclose(got[mean].astype(float), want.mean(), rtol=1e-12)
        np.testing.assert_allclose(got[std].astype(float), want.std(), rtol=1e-9)


def test_equal_values_do_not_deviate(spark):
    rows = bars(spark, 130).withColumn("close", F.lit(0.1) + F.lit(0.2))
    got = apply_waves(rows, DAILY, chained_moments("close", DAILY, (5, 20, 60), {60: ("m", "s")})).toPandas()
    assert set(got.s.dropna()) == {0.0} and set(got.m.dropna()) == {0.1 + 0.2} and got.s.notna().sum() == 71


def test_steps_reach_their_size():
    for n in range(1, 400):
        steps = _steps(n)
        assert steps[-1] == n and all(b % a == 0 for a, b in zip(steps, steps[1:], strict=False))
