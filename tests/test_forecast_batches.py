"""Batch forecasters against the plain ones, on ragged arrays, and what cross-validation shuffles."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.functions import smoothing
from panelmill.operators import forecast


def series(spark, lengths, seed=5, gap=None):
    rnd = np.random.default_rng(seed)
    ys = {f"S{i}": 200 + rnd.normal(size=n).cumsum() for i, n in enumerate(lengths)}
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), None if (k, i) == gap else float(v)) for k, y in ys.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "symbol string, ts date, close double"), ys


@pytest.mark.parametrize("sp", [1, 5])
def test_ragged_series_equal_the_plain_fit(spark, sp, monkeypatch):
    """Lengths around one and two seasons, in blocks of three rows."""
    monkeypatch.setattr(smoothing, "BLOCK", 3)
    df, ys = series(spark, [3, 4, 5, 9, 10, 11, 40, 23, 10])
    got = forecast.forecast(df, list(forecast.MODELS), 7, seasonal_period=sp, log=True).collect()
    assert len(got) == len(ys) * 4 * 7
    want = {(k, m): forecast.fit_forecast(y, m, 7, sp, log=True) for k, y in ys.items() for m in forecast.MODELS}
    for r in got:
        w = want[r["symbol"], r["model"]].iloc[r["step"] - 1]
        assert (r["predicted"], r["lower"], r["upper"]) == pytest.approx((w["predicted"], w["lower"], w["upper"])), r


def test_folds_travel_in_stretches(spark, monkeypatch):
    """A series is shuffled as a few overlapping stretches, not once a fold, and each fold still has its figures once."""
    df, ys = series(spark, [700, 30])
    seen = {}
    plain = smoothing.fold_metrics
    monkeypatch.setattr(smoothing, "fold_metrics", lambda cut, *a: (seen.update(values=cut.agg(F.sum(F.size("y"))).first()[0]), plain(cut, *a))[1])
    got = forecast.cross_validate(df, ["naive", "theta"], test_size=20, step=2).collect()
    folds = {(r["symbol"], r["model"], r["fold"]): r for r in got}
    w, v = 700 // 6, 30 // 6
    assert len(got) == len(folds) == 2 * ((700 - w - 20) // 2 + 1) + 2 * ((30 - v - 20) // 2 + 1)
    assert seen["values"] < 4 * 730
    for at in (0, 127, 128, 255, 256, 281):
        past, ahead = ys["S0"][2 * at : 2 * at + w], ys["S0"][2 * at + w : 2 * at + w + 20]
        r, guess = folds["S0", "theta", at], forecast.fit_forecast(past, "theta", 20)["predicted"].to_numpy()
        assert r["rmse"] == pytest.approx(np.sqrt(((ahead - guess) ** 2).mean()))
        assert r["correlation"] == pytest.approx(np.corrcoef(ahead, guess)[0, 1])
        assert r["num_samples"] == 20


def test_fold_with_a_gap_counts_known_places(spark):
    df, ys = series(spark, [40], gap=("S0", 20))
    got = {r["fold"]: r["num_samples"] for r in forecast.cross_validate(df, ["naive"], splits=4, test_size=6).collect()}
    want = {at: 6 - (8 <= 20 - at < 14) for at in range(27) if at + 7 != 20}
    assert got == want
