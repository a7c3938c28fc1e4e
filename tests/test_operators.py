"""Operators against pandas restatements, edge cases, and the shape of the plans."""

import datetime as dt
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions.axis import DAILY, Axis, apply_waves
from panelmill.functions.recursive import ewm
from panelmill.functions.rolling import rolling_apply, rolling_means, rolling_moments
from panelmill.operators import backtest as bt
from panelmill.operators import clean, evaluate, forecast, indicators, joins, ml, quality_history, sentiment, validation
from panelmill.sources import economic, market, news, orderbook, sinks

BAR = "symbol string, ts date, open double, high double, low double, close double, volume double"


def bars(spark, n=120, symbols=("A", "B"), flat=False, seed=3):
    rnd = random.Random(seed)
    rows = []
    for s in symbols:
        p = 100.0
        for i in range(n):
            p = p if flat else max(5.0, p + rnd.randint(-3, 3))
            rows.append((s, dt.date(2024, 1, 1) + dt.timedelta(days=i), p, p + (0 if flat else 2.0), p - (0 if flat else 1.0), p, 0.0 if flat else float(rnd.randint(1, 50))))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, BAR)


def by_symbol(df, *cols):
    pdf = df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    return {s: g.reset_index(drop=True) for s, g in pdf.groupby("symbol")}


def close(got, want):
    np.testing.assert_allclose(np.array(got, dtype=float), np.array(want, dtype=float), rtol=1e-9, atol=1e-9, equal_nan=True)


# ------------------------------------------------------------ windows


def test_moving_averages_match_pandas(spark):
    for g in by_symbol(indicators.add_moving_averages(bars(spark))).values():
        c = g["close"]
        for n in (5, 10, 20, 50, 100, 200):
            close(g[f"SMA_{n}"], c.rolling(n, min_periods=1).mean())
        for n in (12, 26, 50):
            close(g[f"EMA_{n}"], c.ewm(span=n, adjust=False).mean())
        w = np.arange(1, 11)
        close(g["WMA_10"], c.rolling(10).apply(lambda x: np.dot(x, w) / w.sum(), raw=True))


def test_macd_bollinger_volume_match_pandas(spark):
    df = apply_waves(bars(spark), DAILY, indicators.macd(), indicators.bollinger(), indicators.volume_indicators())
    for g in by_symbol(df).values():
        c, v = g["close"], g["volume"]
        m = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        close(g["MACD"], m)
        close(g["MACD_signal"], m.ewm(span=9, adjust=False).mean())
        close(g["MACD_histogram"], g["MACD"] - g["MACD_signal"])
        sd = c.rolling(20, min_periods=1).std()
        close(g["BB_upper_20_2_5"], c.rolling(20, min_periods=1).mean() + 2.5 * sd)
        wn = g["BB_width_normalized_20"]
        assert (g["BB_squeeze_20"] == (wn < wn.rolling(50).quantile(0.2)).astype(int)).all()
        pvt = (v * c.pct_change()).cumsum()
        close(g["PVT_signal"], pvt.ewm(span=9).mean())
        obv = (v * np.sign(c.diff().fillna(0))).cumsum()
        close(g["OBV"], obv)


def test_flat_prices_give_no_errors(spark):
    out = indicators.technical_indicators(bars(spark, 60, flat=True), fill="reference")
    g = by_symbol(out)["A"]
    assert (g["RSI_14"] == 0).all() and (g["Stoch_K"] == 0).all() and (g["CCI"] == 0).all()
    assert not out.toPandas().isna().any().any()


def test_rsi_bounds_and_limits(spark):
    up = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + i) for i in range(20)], "symbol string, ts date, close double")
    r = by_symbol(indicators.add_rsi(up))["A"]["RSI_14"]
    assert np.isnan(r[0]) and (r[1:] == 100).all()
    r = by_symbol(indicators.add_rsi(bars(spark)))["A"]["RSI_21"].dropna()
    assert r.between(0, 100).all()


def test_long_frames(spark):
    df = bars(spark, 300, symbols=("A",)).withColumn("x", F.when(F.dayofmonth("ts") != 7, F.col("close")))
    df = apply_waves(df, DAILY, rolling_means("x", DAILY, {7: "m7", 90: "m90", 200: "m200"}), rolling_moments("x", DAILY, 252, "lm", "ls"), rolling_means("close", DAILY, {50: "f50"}, "full", "f"))
    df = apply_waves(df, DAILY, rolling_moments("close", DAILY, 252, "cm", "cs", "c"))
    g = by_symbol(df)["A"]
    x = g["x"].astype(float)
    for n in (7, 90, 200):
        close(g[f"m{n}"], x.rolling(n, min_periods=1).mean())
    close(g["f50"], g["close"].rolling(50).mean())
    close(g["cm"], g["close"].rolling(252).mean())
    close(g["cs"], g["close"].rolling(252).std())
    assert g["lm"].isna().all()  # gaps leave no full window


def test_ewm_skips_leading_gaps(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), None if i < 4 else float(i * i % 17)) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, ts date, x double")
    g = by_symbol(apply_waves(df, DAILY, ewm("a", "x", DAILY, 6), ewm("b", "x", DAILY, 6, adjust=True)))["A"]
    close(g["a"], g["x"].ewm(span=6, adjust=False).mean())
    close(g["b"], g["x"].ewm(span=6).mean())


def test_one_shuffle_one_sort_no_python(spark):
    b = bars(spark)
    plan = indicators.technical_indicators(b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    assert "Python" not in plan
    wide = apply_waves(b, DAILY, indicators.moving_averages())._jdf.queryExecution().executedPlan().toString()
    assert wide.count("Exchange hashpartitioning") == 1


def test_user_statistic(spark):
    frame, call = rolling_apply("close", DAILY, 10, np.ptp)
    g = by_symbol(bars(spark, 30).withColumn("f", frame).withColumn("y", call("f")).drop("f"))["A"]
    close(g["y"], g["close"].rolling(10).apply(np.ptp))


# ------------------------------------------------------------ cleaning


def test_fills(spark):
    vals = [None, 1.0, None, None, None, None, None, None, 8.0, None, None]
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(vals)], "symbol string, ts date, x double")
    s = pd.Series(vals, dtype=float)
    got = lambda d: by_symbol(d)["A"]["x"]
    close(got(clean.interpolate(df, ["x"], limit=5)), s.interpolate(limit=5))
    close(got(clean.interpolate(df, ["x"])), s.interpolate())
    close(got(clean.forward_fill(df, ["x"], limit=2)), s.ffill(limit=2))
    close(got(clean.back_fill(df, ["x"])), s.bfill())
    close(got(clean.mean_fill(df, ["x"])), s.fillna(s.mean()))


def test_clean_market_data(spark):
    rows = [("A", "2024-01-02", 0, 5.0), ("A", "2024-01-01", 1, None), ("A", "2024-01-02", 2, 9.0), ("A", "bad", 3, 1.0), ("A", "2024-01-04", 4, None), ("A", "2024-01-05", 5, 7.0)]
    df = spark.createDataFrame(rows, "symbol string, ts string, seq int, close double")
    out = clean.clean_market_data(df, order=["seq"]).orderBy("ts").collect()
    assert [r["close"] for r in out] == [5.0, 7.0]
    assert [r["ts"].day for r in out] == [2, 5]


def test_keep_first_ties_do_not_depend_on_layout(spark):
    rows = [("k", 1, "b"), ("k", 1, "a"), ("k", 2, "c")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    for n in (1, 3):
        assert clean.keep_first(df.repartition(n), ["k"], ["o"]).first()["v"] == "a"


def test_infinite_and_sparse(spark):
    df = spark.createDataFrame([("A", i, float("inf") if i == 0 else float("nan") if i == 1 else 1.0, None if i < 3 else 1.0) for i in range(5)], "symbol string, ts int, x double, y double")
    out = clean.drop_sparse_columns(clean.drop_infinite(df))
    assert out.columns == ["symbol", "ts", "x"] and out.filter("x is null").count() == 2


# ------------------------------------------------------------ sources


def test_read_bars_pushes_filters_down(spark, tmp_path):
    bars(spark).write.parquet(f"{tmp_path}/b")
    df = market.read_bars(spark, f"{tmp_path}/b", ["A"], "2024-02-01", "2024-02-10").select("ts", "close")
    assert df.count() == 10
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "GreaterThanOrEqual(ts" in plan and "volume" not in plan.split("ReadSchema")[1]


def test_csv_round_trip_and_partitioned_sink(spark, tmp_path):
    sinks.write_table(bars(spark), f"{tmp_path}/c", "csv")
    assert market.read_bars(spark, f"{tmp_path}/c", fmt="csv").count() == 240
    sinks.write_table(bars(spark), f"{tmp_path}/p", partition_by=["symbol"])
    assert spark.read.parquet(f"{tmp_path}/p").filter("symbol = 'B'").count() == 120


def test_orderbook(spark, tmp_path):
    head = "Timestamp,Bid_Price_1,Bid_Size_1,Ask_Price_1,Ask_Size_1,bid_price_2,bid_size_2,ask_price_2,ask_size_2"
    (tmp_path / "ob.csv").write_text(head + "\n2024-01-01T12:00:00Z,10,1,11,2,9,3,12,4\n")
    ob = orderbook.load_orderbook_csv(spark, str(tmp_path / "ob.csv"), depth=2, tz="America/New_York")
    r = ob.first()
    assert ob.columns[:3] == ["ts", "bid_price", "bid_size"] and r["ts"].hour == 7 and r["ask_size_2"] == 4.0
    with pytest.raises(ValueError):
        orderbook.load_orderbook_csv(spark, str(tmp_path / "ob.csv"), depth=3)


def test_articles_json_and_scoring(spark, tmp_path):
    rows = [{"source": {"id": None, "name": "wire"}, "title": f"t{i}", "description": None, "url": f"u{i % 2}", "publishedAt": f"2024-01-0{i + 1}T00:00:00Z"} for i in range(4)]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    a = news.read_articles(spark, str(tmp_path / "a.json"))
    assert a.first()["source_name"] == "wire"
    merged = news.merge_queries([a.filter("title != 't0'"), a])
    assert {r["url"]: r["title"] for r in merged.collect()} == {"u1": "t1", "u0": "t2"}
    neutral = news.score_articles(a).first()
    assert (neutral["negative"], neutral["neutral"], neutral["compound"]) == (0.0, 1.0, 0.0)
    scored = news.score_articles(a, lambda: (lambda texts: [(0.2, 0.3, 0.5)] * len(texts)))
    assert scored.first()["compound"] == pytest.approx(0.3)

    def broken():
        def call(text):
            raise RuntimeError("no model")

        return call

    assert news.score_with_model(a, broken).first()["llm_sentiment"] == 0.0
    assert news.summarise_days(a.withColumn("symbol", F.lit("A"))).first()["daily_summary"] == ""


def test_day_summaries_are_folded_in_parts(spark):
    a = spark.createDataFrame([("A", dt.date(2024, 1, 1 + i % 2), f"w{i}", f"u{i}") for i in range(30)], "symbol string, publishedAt date, title string, url string")
    out = news.summarise_days(a, lambda texts: " ".join(sorted(" ".join(texts).split())), per_call=1000)
    got = {r["publishedAt"].day: r["daily_summary"].split() for r in out.select("publishedAt", "daily_summary").distinct().collect()}
    assert sorted(got[1] + got[2]) == sorted(f"w{i}" for i in range(30))


def test_indicator_lookup(spark):
    df = spark.createDataFrame([("federal FUNDS rate",), ("XYZ",)], "name string")
    assert [r["series_id"] for r in economic.resolve_indicator(df).collect()] == ["DFF", "XYZ"]


def test_recession_open_run_is_dropped(spark):
    flags = [0, 1, 1, 0, 1, 0, 1, 1]
    df = spark.createDataFrame([(dt.date(2024, i + 1, 1), f) for i, f in enumerate(flags)], "date date, flag int")
    got = [(r["start"].month, r["end"].month, r["duration_days"]) for r in economic.recession_runs(df).orderBy("start").collect()]
    assert got == [(2, 4, 60), (5, 6, 31)]


# ------------------------------------------------------------ joins


def test_low_frequency_detection(spark):
    m = bars(spark, 60, symbols=("A",))
    month = spark.createDataFrame([("X", dt.date(2024, k, 1), float(k)) for k in (1, 2)], "series_id string, date date, value double")
    assert joins.is_low_frequency(m, month)
    out = joins.align_macro(m, month, ["X"]).orderBy("ts").collect()
    assert out[40]["X"] == 2.0 and out[40]["X_days_since_update"] == 9


def test_asof_skip_missing(spark):
    left = spark.createDataFrame([("A", 5), ("A", 1)], "symbol string, ts int")
    right = spark.createDataFrame([("A", 2, 1.0), ("A", 4, None)], "symbol string, ts int, v double")
    take = lambda **k: {r["ts"]: r["v"] for r in joins.asof_join(left, right, ["v"], **k).collect()}
    assert take() == {1: None, 5: None} and take(skip_missing=True) == {1: None, 5: 1.0}


# ------------------------------------------------------------ validation


def test_clean_data_has_no_errors(spark):
    weekdays = bars(spark, 80).filter(F.weekday("ts") < 5).withColumn("close", F.col("close") + F.dayofyear("ts") / 1000)
    issues, reports = validation.validate_market(weekdays.withColumn("high", F.col("close") + 2))
    assert issues.filter("severity in ('ERROR', 'CRITICAL')").count() == 0
    assert reports.filter("is_valid").count() == 2


def test_empty_and_missing_columns(spark):
    empty = bars(spark).limit(0)
    issues, reports = validation.validate_market(empty, by=())
    assert [r["severity"] for r in issues.filter("category = 'structure'").collect()] == ["CRITICAL"]
    assert not reports.first()["is_valid"]
    issues, _ = validation.validate_market(bars(spark).drop("open"))
    assert issues.filter("category = 'columns' and message like '%open%'").count() == 2
    text = bars(spark).withColumn("close", F.col("close").cast("string"))
    found = {(r["severity"], r["column"]) for r in validation.validate_market(text)[0].filter("category = 'data_types'").collect()}
    assert found == {("ERROR", "close"), ("INFO", "close")}


def test_unsorted_arrival(spark):
    df = bars(spark, 30).withColumn("seq", -F.datediff("ts", F.lit("2024-01-01")))
    assert validation.validate_market(df, ingest="seq")[0].filter("message like '%sorted%'").count() == 2


def test_history_round_trip(spark, tmp_path):
    _, reports = validation.validate_market(bars(spark))
    run = quality_history.run_summary(reports.withColumn("run_ts", F.lit("2024-01-01").cast("timestamp")).withColumn("category", F.lit("market")))
    sinks.append_history(run, f"{tmp_path}/h")
    sinks.append_history(run.withColumn("run_ts", F.lit("2024-01-02").cast("timestamp")), f"{tmp_path}/h")
    h = sinks.read_history(spark, f"{tmp_path}/h")
    assert h.count() == 2
    assert quality_history.trends(h).first()["pass_rate_trend"] == "stable"


# ------------------------------------------------------------ back-test


def test_flip_keeps_trade_open_and_open_trade_is_dropped(spark):
    words = ["buy", "sell", "hold", "long", "long"]
    df = spark.createDataFrame([("A", i, 10.0 + i, w) for i, w in enumerate(words)], "symbol string, ts int, close double, signal string")
    t = bt.trades(bt.run(df)).collect()
    assert len(t) == 1
    assert (t[0]["entry_ts"], t[0]["exit_ts"], t[0]["direction"], t[0]["pnl"]) == (1, 3, "long", 2.0)


def test_misaligned_signals_are_refused(spark):
    p = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 1.0)], "symbol string, ts int, close double")
    with pytest.raises(ValueError):
        bt.check_alignment(p, p.filter("ts = 1").select("symbol", "ts"))


# ------------------------------------------------------------ forecasts and models


def test_forecasters_on_known_series():
    line = np.arange(50, dtype=float) * 2 + 5
    step = np.arange(1, 4)
    assert np.allclose(forecast.fit_forecast(line, "exp_smoothing", 3)["predicted"], line[-1] + 2 * step)
    # simple smoothing trails a line by slope * (1 - a) / a; theta adds half the slope per step
    a = 0.95
    level = line[-1] - 2 * (1 - a) / a
    assert np.allclose(forecast.fit_forecast(line, "theta", 3)["predicted"], level + step - 1 + 1 / a)
    season = np.tile([1.0, 5.0, 2.0, 8.0], 12)
    assert np.allclose(forecast.fit_forecast(season, "naive", 4, sp=4)["predicted"], [1, 5, 2, 8])
    assert np.abs(forecast.fit_forecast(season, "exp_smoothing", 4, sp=4)["predicted"] - [1, 5, 2, 8]).max() < 0.6
    iv = forecast.fit_forecast(line + np.sin(line), "naive", 2, coverage=0.95)
    assert (iv["lower"] < iv["predicted"]).all() and (iv["predicted"] < iv["upper"]).all()


def test_update_equals_refit(spark):
    b = bars(spark, 60)
    old, new = b.filter("ts < '2024-02-20'"), b.filter("ts >= '2024-02-20'")
    key = ["symbol", "step", "model"]
    a = forecast.update_forecast(old, new, models=["theta"]).orderBy(*key).collect()
    assert a == forecast.forecast(b, models=["theta"]).orderBy(*key).collect()


def test_t_distribution():
    assert evaluate.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert evaluate.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert evaluate.t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)


def test_ridge_and_save_load(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = x @ [2.0, -1.0] + 0.5 + rng.normal(scale=0.1, size=80)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "target": y}))
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(2), xc.T @ yc)
    model = ml.build("ridge", df, ["a", "b"], alpha=5.0)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(want, rel=1e-8)
    ml.save_model(model, f"{tmp_path}/m")
    again = ml.predict(ml.load_model(f"{tmp_path}/m"), df).toPandas()["prediction"]
    assert again.to_list() == pytest.approx(ml.predict(model, df).toPandas()["prediction"].to_list())
    assert [n for n, _ in ml.feature_importance(model, ["a", "b"])] == ["a", "b"]
    assert ml.select_features(df.withColumn("flat", F.lit(1.0)), ["a", "b", "flat"], k=1) == ["a"]
    assert ml.with_missing_features(df, ["a", "zz"]).first()["zz"] == 0.0


def test_folds_move_forward_in_time(spark):
    folds = ml.time_folds(bars(spark, 40), 3)
    assert len(folds) == 3 and all(a[1] < b[0] for a, b in zip(folds, folds[1:]))


def test_partition_count_does_not_matter(spark):
    b = bars(spark, 60, symbols=("A", "B", "C"))
    runs = []
    for n in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(bt.metrics(bt.backtest(b.repartition(n))).orderBy("symbol").collect())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert runs[0] == runs[1]


def test_key_of_two_columns(spark):
    b = bars(spark, 30).withColumn("venue", F.lit("X"))
    axis = Axis(key=("symbol", "venue"))
    out = indicators.add_moving_averages(b, axis, sma=(5,), ema=(), wma=())
    assert out.filter("SMA_5 is null").count() == 0


def test_missing_source_is_not_dominant(spark):
    rows = spark.createDataFrame([("A", 1, 0.5, "x"), ("A", 1, 0.1, None), ("A", 1, 0.2, None), ("B", 1, 0.3, None)], "symbol string, day int, score double, source string")
    got = {r["symbol"]: (r["source_diversity"], r["dominant_source_pct"]) for r in sentiment.source_breakdown(rows, ["symbol", "day"], "score", "source").collect()}
    assert got["A"] == (1, pytest.approx(1 / 3))
    assert got["B"] == (0, None)


def test_cross_validation_visits_every_fold(spark):
    rnd = np.random.default_rng(3)
    series = {"A": 100 + rnd.normal(size=70).cumsum(), "B": 50 + rnd.normal(size=41).cumsum(), "C": np.arange(9.0)}
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
    bars = spark.createDataFrame(rows, "symbol string, ts date, close double")
    models = ["exp_smoothing", "theta", "naive", "ensemble"]
    got = {(r["symbol"], r["model"], r["fold"]): r["mae"] for r in forecast.cross_validate(bars, models, splits=4, test_size=6).collect()}
    want = {}
    for k, ys in series.items():
        w = len(ys) // 5
        for at in range(len(ys) - w - 6 + 1 if w >= 3 else 0):
            for m in models:
                guess = forecast.fit_forecast(ys[at : at + w], m, 6)["predicted"].to_numpy()
                want[k, m, at] = np.abs(ys[at + w : at + w + 6] - guess).mean()
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


def test_series_too_short_are_named(spark):
    rows = [("A", i, float(i)) for i in range(5)] + [("B", 0, 1.0), ("B", 1, None)]
    got = forecast.too_short(spark.createDataFrame(rows, "symbol string, ts int, close double")).collect()
    assert [(r["symbol"], r["known"], r["reason"]) for r in got] == [("B", 1, "1 known values, 3 needed")]


def test_volume_just_one_deviation_off_is_no_surprise(spark):
    """9, 17, 12, 11, 11, 15, 9 has mean 12 and deviation 3: the last day lies on the edge, and 8 in its place beyond it."""
    for last, want in ((9, 0), (8, 1)):
        rows = [("A", dt.date(2024, 1, i + 1), n) for i, n in enumerate([9, 17, 12, 11, 11, 15, last])]
        df = spark.createDataFrame(rows, "symbol string, ts date, news_volume long")
        got = sentiment.news_volume_table(df, attention=()).orderBy("ts").collect()[-1]
        assert (got["negative_news_surprise"], got["news_volume_dry_spell"]) == (want, want)
