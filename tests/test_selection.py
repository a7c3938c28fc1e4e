"""Quantiles by sketch and exact counts, duplicate rows by fingerprint, p-values, co-moments, bar tables, day summaries."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions import quantiles
from panelmill.functions.axis import DAILY, apply_waves
from panelmill.functions.quantiles import column_quantiles
from panelmill.functions.rolling import rolling_correlation
from panelmill.operators import clean, evaluate, validation
from panelmill.sources import market, news, sinks

PROBS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


def check_quantiles(spark, pdf, keys, columns, **kw):
    df = spark.createDataFrame(pdf).repartition(3)
    got = {tuple(r[k] for k in [*keys, "column"]): r for r in column_quantiles(df, keys, columns, PROBS, **kw).collect()}
    groups = pdf.groupby(keys, dropna=False) if keys else [((), pdf)]
    n = 0
    for key, g in groups:
        key = tuple(None if isinstance(k, float) and math.isnan(k) else k for k in (key if isinstance(key, tuple) else (key,)))
        for c in columns:
            r = got[(*key, c)]
            x = g[c].dropna()
            assert r["known"] == len(x)
            want = [None if x.empty else float(np.quantile(x, p)) for p in PROBS.values()]
            assert [r[k] for k in PROBS] == (want if x.empty else pytest.approx(want, rel=1e-12))
            n += 1
    assert n == len(got)


def test_quantiles(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"s": np.array(["a", "b", "c", None], object)[r.choice(4, 3000, p=[0.7, 0.2, 0.09, 0.01])], "x": r.normal(size=3000) * 1e6, "y": r.integers(0, 3, 3000).astype(float), "z": np.where(r.random(3000) < 0.4, np.nan, r.lognormal(0, 9, 3000))})
    pdf.loc[pdf["s"] == "c", "z"] = np.nan
    check_quantiles(spark, pdf, ["s"], ["x", "y", "z"])
    check_quantiles(spark, pdf, [], ["x", "y"])


@pytest.mark.parametrize("kw", [{"accuracy": 20}, {"between": 5}, {"accuracy": 20, "between": 100}])
def test_quantiles_fall_back(spark, kw):
    """Coarse sketches, and cuts that hold more than a task may: those cells are sorted."""
    r = np.random.default_rng(2)
    pdf = pd.DataFrame({"s": ["a"] * 900 + ["b"] * 100, "x": r.normal(size=1000), "y": r.integers(0, 2, 1000).astype(float)})
    check_quantiles(spark, pdf, ["s"], ["x", "y"], **kw)


def test_quantiles_of_cuts_that_miss(spark, monkeypatch):
    pdf = pd.DataFrame({"s": ["a"] * 400, "x": np.arange(400.0)})
    monkeypatch.setattr(quantiles, "_cut_shares", lambda probs, accuracy: [0.1 for _ in probs for _ in (0, 1)])
    check_quantiles(spark, pdf, ["s"], ["x"])


def test_no_row_per_cell(spark, sf):
    """Outlier counts of a table: no Generate over rows times columns, neither heavy nor plain."""
    rows = spark.createDataFrame([("a", float(i % 50), float(i)) for i in range(300)], "symbol string, x double, y double")
    for heavy in (False, True):
        got = validation.outlier_counts(rows.union(rows.limit(1).withColumn("x", F.lit(1e6))), ["x", "y"], heavy=heavy)
        assert {r["column"]: (r["known"], r["outliers"]) for r in got.collect()} == {"x": (301, 1), "y": (301, 0)}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("Aggregate")  # only over the rows of the aggregate


def test_duplicate_rows(spark):
    rows = [("a", 1, 1.0, "x"), ("a", 1, 1.0, "x"), ("a", None, 1.0, "x"), ("a", 1, None, "x"), ("b", 1, 0.0, "y"), ("b", 1, -0.0, "y"), ("b", 1, 0.0, "y"), ("c", 1, 1.0, "z"), (None, 2, 2.0, "w"), (None, 2, 2.0, "w")]
    df = spark.createDataFrame(rows, "symbol string, n int, v double, t string")
    want = {("a", 1), ("b", 2), (None, 1)}
    assert {tuple(r) for r in validation.duplicate_rows(df, ["symbol"], ["n", "v", "t"]).collect()} == want
    # all rows with equal bits: values decide
    same = lambda on: [F.lit(1).cast("long"), F.lit(2).cast("long")]
    assert {tuple(r) for r in validation.duplicate_rows(df, ["symbol"], ["n", "v", "t"], fingerprint=same).collect()} == want


def test_duplicates_shuffle_two_numbers(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(validation, "settle", lambda d: seen.append(d) or d)
    wide = spark.range(100).select(F.concat(F.lit("s"), F.col("id") % 3).alias("symbol"), *[(F.col("id") + i).alias(f"c{i}") for i in range(30)]).repartition(3)
    validation.duplicate_rows(wide, ["symbol"], [f"c{i}" for i in range(30)])
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    last = plan.rindex("hashpartitioning(symbol")
    assert "_fa" in plan[last : last + 120] and "c29" not in plan[last : last + 120]


def test_p_values(spark):
    """Against the plain-number version, itself held to tables in test_operators."""
    pairs = [(t, n) for n in (1, 2, 3, 7, 30, 251, 5000, 200_000) for t in (0.0, 1e-6, 0.3, -1.0, 2.0, 5.5, 40.0)]
    df = spark.createDataFrame(pairs, "t double, n long")
    for r in df.withColumn("p", evaluate.two_sided_p(F.col("t"), F.col("n"))).collect():
        assert r["p"] == pytest.approx(evaluate.t_two_sided(r["t"], r["n"]), abs=1e-9), r
    none = spark.createDataFrame([(None, 5), (1.0, 0), (1.0, None)], "t double, n long")
    assert [r["p"] for r in none.select(evaluate.two_sided_p(F.col("t"), F.col("n")).alias("p")).collect()] == [None] * 3


@pytest.mark.parametrize("n", [10, 40, 252])
def test_rolling_correlation(spark, n):
    """Large constants with little noise, gaps, and flat stretches."""
    r = np.random.default_rng(n)
    size = 600
    x, y = 1e7 + r.normal(size=size), 5e6 + r.normal(size=size)
    y[100:200] += (x - 1e7)[100:200] * 3
    x[300 : 300 + n + 5] = 7.0
    gap = r.random(size) < 0.05
    df = spark.createDataFrame([("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(a), None if g else float(b)) for i, (a, b, g) in enumerate(zip(x, y, gap))], "symbol string, ts date, x double, y double")
    got = apply_waves(df, DAILY, rolling_correlation("x", "y", DAILY, n, "r", need=n // 2)).orderBy("ts").collect()
    assert set(got[0].asDict()) == {"symbol", "ts", "x", "y", "r"}
    for i, g in enumerate(got):
        a, b = x[max(0, i - n + 1) : i + 1], y[max(0, i - n + 1) : i + 1]
        ok = ~gap[max(0, i - n + 1) : i + 1]
        a, b = a[ok], b[ok]
        if len(a) < n // 2 or a.min() == a.max() or b.min() == b.max():
            assert g["r"] is None, i
        else:
            assert g["r"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6), i


def bars(n=120, symbols="ABC"):
    return [(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 1.0, 2.0, 0.5, float(i), 10.0) for s in symbols for i in range(n)]


def test_bar_table(spark, tmp_path):
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    path = f"{tmp_path}/bars"
    sinks.write_bar_table(spark.createDataFrame(bars(), schema), path)
    february = [(s, t, o, h, lo, c, 99.0) for s, t, o, h, lo, c, _ in bars() if t.month == 2 and s != "C"]
    before = sorted(str(p) for p in (tmp_path / "bars" / "month=202403").iterdir())
    sinks.write_bar_table(spark.createDataFrame(february, schema), path)
    assert before == sorted(str(p) for p in (tmp_path / "bars" / "month=202403").iterdir())  # other months are not touched
    df = market.read_bar_table(spark, path, ["A", "C"], "2024-02-27", "2024-03-02")
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "202402" in filters and "202403" in filters and "In(symbol" in plan.replace(" ", "")
    got = sorted((r["symbol"], r["ts"].day, r["volume"]) for r in df.collect())
    assert got == sorted([("A", d, 99.0) for d in (27, 28, 29)] + [(s, d, 10.0) for s in "AC" for d in (1, 2)])
    assert market.read_bar_table(spark, path).count() == 3 * 120 - 29


def test_day_summaries_are_repeatable_and_one_call_a_day(spark):
    rows = [("A" if i % 3 else None, dt.datetime(2024, 1, 1 + i % 2, i % 5), f"t{i}", None if i % 4 == 0 else f"d{i}", f"u{i % 11}") for i in range(60)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, publishedAt timestamp, title string, description string, url string")
    joined = lambda texts: "|".join(texts)
    want = {}
    for s, t, title, d, u in sorted(rows, key=lambda r: (r[1], r[4], f"{r[2]} {r[3] or ''}")):
        want.setdefault((s, t.day), []).append(f"{title} {d or ''}")
    for parts in (1, 5):
        out = news.summarise_days(df.repartition(parts), joined).select("symbol", "publishedAt", "daily_summary").collect()
        assert {(r["symbol"], r["publishedAt"].day): r["daily_summary"] for r in out} == {k: "|".join(v) for k, v in want.items()}
    # longer days: summaries of stretches of seven, in order, and of these again
    tag = lambda texts: "(" + "|".join(texts) + ")"

    def folded(texts):
        while True:
            texts = [tag(texts[i : i + 7]) for i in range(0, len(texts), 7)]
            if len(texts) == 1:
                return texts[0]

    out = news.summarise_days(df.repartition(4), tag, per_call=7).collect()
    longest = max(len(v) for v in want.values())
    assert longest > 7
    for r in out:
        texts = want[r["symbol"], r["publishedAt"].day]
        assert r["daily_summary"].replace("(", "").replace(")", "") == "|".join(texts)
        if len(texts) == longest:
            assert r["daily_summary"] == folded(texts)
    assert len(out) == 60


def test_gap_columns(spark):
    """Only what is missing after a known value in some series; interpolating those alone changes nothing else."""
    rows = [("A", i, 1.0 if i != 3 else None, None if i < 2 else float(i), None, float(i), None if i == 5 else 2.0) for i in range(6)]
    rows += [("B", i, 1.0, None if i < 3 else 4.0, None, float(i), 3.0) for i in range(5)]
    df = spark.createDataFrame(rows, "symbol string, ts int, hole double, lead double, none double, full double, tail double")
    cols = ["hole", "lead", "none", "full", "tail"]
    assert clean.gap_columns(df, cols) == ["hole", "tail"]
    assert clean.gap_columns(df.limit(0), cols) == []
    some, every = (clean.interpolate(df, c, limit=5).orderBy("symbol", "ts").collect() for c in (["hole", "tail"], cols))
    assert some == every
