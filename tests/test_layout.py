"""The blocked layout must give what the plain layout gives, wherever the cuts fall."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions.axis import Axis, Scan, exact_quantiles, in_blocks, number_rows, per_key, running
from panelmill.operators import backtest as bt
from panelmill.operators import clean, indicators, joins

AXIS = Axis(tie=("seq",))


@pytest.fixture(scope="module")
def ticks(spark):
    rnd = random.Random(7)
    rows = []
    for sym, n in (("A", 700), ("B", 23), ("C", 1)):
        t = dt.datetime(2024, 1, 1)
        for i in range(n):
            t += dt.timedelta(seconds=rnd.choice([0, 1, 5, 60]))
            p = 100.0 + rnd.randint(-20, 20)
            rows.append((sym, t, i, p, p + rnd.randint(0, 3), p - rnd.randint(0, 3), float(rnd.randint(1, 9)), p if rnd.random() < 0.6 else None))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, close double, high double, low double, volume double, gappy double").persist()


def as_rows(df, cols):
    pdf = df.select("symbol", "seq", *cols).toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True)
    return pdf


def same(a, b, cols):
    pd.testing.assert_frame_equal(as_rows(a, cols), as_rows(b, cols), check_dtype=False, rtol=1e-9, atol=1e-9)


def test_number_rows(ticks):
    got = number_rows(ticks, AXIS, count="n", partitions=7).select("symbol", "seq", "__rn", "n").toPandas()
    assert (got["seq"] == got["__rn"]).all()
    assert got.groupby("symbol")["n"].first().to_dict() == {"A": 700, "B": 23, "C": 1}


@pytest.mark.parametrize("block", [31, 64, 1000])
def test_scans(ticks, block):
    scans = {
        "s": Scan("sum", F.col("gappy")),
        "k": Scan("count", F.col("gappy")),
        "m": Scan("max", F.col("close")),
        "n": Scan("min", F.col("close")),
        "p": Scan("product", 1 + F.col("volume") / 1000),
        "f": Scan("last", F.col("gappy")),
        "b": Scan("next", F.col("gappy")),
    }
    blocked = in_blocks(ticks, AXIS, lambda d, a: running(d, a, scans), before=11, after=3, rows_per_block=block)
    same(blocked, running(ticks, AXIS, scans), list(scans))
    assert blocked.count() == ticks.count()


def test_whole_indicator_set(ticks):
    plain = indicators.technical_indicators(ticks, AXIS)
    cols = [c for c in plain.columns if c not in ticks.columns and dict(plain.dtypes)[c] in ("double", "int")]
    blocked = in_blocks(ticks, AXIS, lambda d, a: indicators.technical_indicators(d, a), before=400, rows_per_block=401)
    # 400 rows of history leave weights below 1e-6 in the slowest mean
    pd.testing.assert_frame_equal(as_rows(blocked, cols), as_rows(plain, cols), check_dtype=False, rtol=1e-5, atol=1e-5)


def test_backtest_and_trades(ticks):
    sig = ticks.withColumn("signal", F.when(F.col("seq") % 13 < 4, "buy").when(F.col("seq") % 13 < 8, "sell").otherwise("hold"))
    cols = ["position", "net_return", "equity", "drawdown"]
    same(in_blocks(sig, AXIS, lambda d, a: bt.run(d, a), before=3, rows_per_block=50), bt.run(sig, AXIS), cols)

    def both(d, a):
        return bt.trades(bt.run(d, a), a)

    plain = both(sig, AXIS).toPandas().sort_values(["symbol", "exit_ts", "pnl"]).reset_index(drop=True)
    cut = in_blocks(sig, AXIS, both, before=3, rows_per_block=50).toPandas().sort_values(["symbol", "exit_ts", "pnl"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(cut[plain.columns], plain, check_dtype=False)
    assert len(plain) > 40


def test_fills(ticks):
    both = ticks.withColumn("line", F.col("gappy")).withColumn("mean", F.col("gappy")).select("symbol", "ts", "seq", "line", "mean")

    def work(d, a):
        return clean.mean_fill(clean.interpolate(d, ["line"], a, limit=2), ["mean"], a)

    same(in_blocks(both, AXIS, work, before=0, rows_per_block=37), work(both, AXIS), ["line", "mean"])


def test_asof(ticks):
    right = ticks.filter("seq % 5 = 0").groupBy("symbol", "ts").agg(F.max("gappy").alias("v"))
    left = ticks.select("symbol", "ts", "seq")
    plain = joins.asof_join(left, right, ["v"], AXIS, observed="at")
    same(joins.asof_join(left, right, ["v"], AXIS, observed="at", blocked=True, rows_per_block=40), plain, ["v"])
    pl, pr = left.toPandas().sort_values(["ts", "seq"]), right.toPandas().sort_values("ts")
    want = pd.merge_asof(pl, pr, on="ts", by="symbol").sort_values(["symbol", "seq"]).reset_index(drop=True)
    pd.testing.assert_series_equal(as_rows(plain, ["v"])["v"], want["v"], check_dtype=False)


def test_quantiles(ticks):
    got = {r["symbol"]: (r["a"], r["b"]) for r in exact_quantiles(ticks, ["symbol"], "gappy", {"a": 0.25, "b": 0.9}).collect()}
    pdf = ticks.toPandas()
    for s, g in pdf.dropna(subset=["gappy"]).groupby("symbol"):
        assert got[s] == pytest.approx((g["gappy"].quantile(0.25), g["gappy"].quantile(0.9)))


def test_per_key(ticks):
    blocked = in_blocks(ticks, AXIS, lambda d, a: per_key(d, a, {"m": F.avg("close")}), before=5, rows_per_block=29)
    same(blocked, per_key(ticks, AXIS, {"m": F.avg("close")}), ["m"])


def test_layout_follows_the_data(ticks):
    cols = ["SMA_20", "OBV", "VWAP"]
    pick = lambda longest: indicators.technical_indicators_any_length(ticks, AXIS, longest=longest, rows_per_block=2000)
    same(pick(10), pick(10_000), cols)
    assert "__block" in pick(10)._jdf.queryExecution().logical().toString()
    assert "__block" not in pick(10_000)._jdf.queryExecution().logical().toString()


def test_quantiles_where_half_of_the_rows_hold_one_value(spark):
    rows = spark.range(4000).select(F.lit("A").alias("symbol"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    want = rows.toPandas()["v"].quantile([0.25, 0.5, 0.9]).tolist()
    got = exact_quantiles(rows, ["symbol"], "v", {"a": 0.25, "b": 0.5, "c": 0.9})
    assert list(got.select("a", "b", "c").first()) == pytest.approx(want)


def test_quantiles_keep_a_missing_key(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("A", 5.0), ("A", None)], "symbol string, v double")
    assert {r["symbol"]: r["m"] for r in exact_quantiles(rows, ["symbol"], "v", {"m": 0.5}).collect()} == {None: 2.0, "A": 5.0}


def test_numbering_refuses_a_missing_key(spark):
    rows = spark.createDataFrame([("A", 1), (None, 2)], "symbol string, ts long")
    with pytest.raises(Exception, match="NULL in key column symbol"):
        number_rows(rows, Axis()).collect()
