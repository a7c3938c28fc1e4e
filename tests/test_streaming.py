"""Streaming jobs against their batch twins, fed from files with availableNow."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.operators import sentiment
from panelmill.plans import fixtures as fx
from panelmill.streaming import jobs


def drain(spark, df, tmp, mode="append", name="out"):
    q = (
        df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{tmp}/ck-{name}").option("path", f"{tmp}/{name}")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination(180)
    assert not q.isActive
    return spark.read.parquet(f"{tmp}/{name}")


def as_stream(spark, df, tmp, parts=3, order="ts"):
    """Write a table as a few files in time order and read it back as a stream, one file a batch."""
    for i in range(parts):
        lo, hi = i / parts, (i + 1) / parts
        cut = df.withColumn("_r", F.percent_rank().over(Window.orderBy(order)))
        part = cut.filter((F.col("_r") >= lo) & ((F.col("_r") < hi) | F.lit(i == parts - 1))).drop("_r")
        part.coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp}/in")


@pytest.fixture(scope="module")
def news(spark, sf):
    return fx.news(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).persist()


def test_daily_sentiment(spark, news, tmp_path):
    out = drain(spark, jobs.daily_sentiment_stream(as_stream(spark, news, tmp_path)), tmp_path)
    cols = ["symbol", "date", "sentiment_mean", "news_volume", "positive_sentiment_count"]
    got = out.select(*cols).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    batch = sentiment.daily_sentiment(news, source=None, intraday=False).select(*cols).toPandas()
    last = got["date"].max()
    want = batch[batch["date"] <= last].sort_values(["symbol", "date"]).reset_index(drop=True)
    assert len(got) > 20
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_first_articles(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"u{i % 7}", t0 + dt.timedelta(minutes=i), i) for i in range(30)]
    df = spark.createDataFrame(rows, "url string, publishedAt timestamp, n int")
    out = drain(spark, jobs.first_articles(as_stream(spark, df, tmp_path, order="publishedAt")), tmp_path)
    assert sorted(r["url"] for r in out.collect()) == [f"u{i}" for i in range(7)]


def test_minute_bars(spark, news, tmp_path):
    q = news.select("symbol", "ts", "event_id", F.col("confidence").alias("price"), F.lit(1.0).alias("size"))
    out = drain(spark, jobs.minute_bars(as_stream(spark, q, tmp_path), width="1 day", seq="event_id"), tmp_path)
    got = out.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    pdf = q.toPandas().sort_values(["ts", "event_id"])
    pdf["day"] = pdf["ts"].dt.floor("D")
    want = pdf.groupby(["symbol", "day"])["price"].agg(["first", "max", "min", "last", "count"]).reset_index()
    want = want[want["day"] <= got["ts"].max()].reset_index(drop=True)
    assert (got[["open", "high", "low", "close", "volume"]].to_numpy() == want[["first", "max", "min", "last", "count"]].to_numpy()).all()


def test_running_state(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, t0 + dt.timedelta(days=i), 100.0 + (i * k) % 13, float(i % 5 + 1)) for s, k in (("A", 3), ("B", 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, volume double")
    out = drain(spark, jobs.running_state(as_stream(spark, df, tmp_path), span=12), tmp_path).toPandas()
    for s, g in df.toPandas().groupby("symbol"):
        g = g.sort_values("ts")
        o = out[out["symbol"] == s].sort_values("ts")
        assert o["ema"].to_list() == pytest.approx(g["close"].ewm(span=12, adjust=False).mean().to_list())
        step = g["close"].diff().fillna(0)
        assert o["obv"].to_list() == pytest.approx((g["volume"] * (step > 0) - g["volume"] * (step < 0)).cumsum().to_list())


def test_quality_sink(spark, sf, tmp_path):
    bad = fx.faulty_bars(spark, sf).drop("rn", "copy")
    stream = as_stream(spark, bad, tmp_path, parts=2)
    history = f"{tmp_path}/history"
    q = stream.writeStream.foreachBatch(jobs.quality_sink(history, by=(), now="2030-01-01")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.read.parquet(history)
    assert got.select("batch_id").distinct().count() == 2
    assert got.filter("category = 'business_logic'").count() > 0
    before = got.count()
    jobs.quality_sink(history, by=(), now="2030-01-01")(bad, 0)  # a replayed batch adds nothing
    assert spark.read.parquet(history).count() == before
