"""Wide feature tables are worked out where they are read, not stored."""

import datetime as dt

import pytest

from panelmill.operators import clean, unified, validation
from panelmill.plans import modeling


@pytest.fixture
def widths(monkeypatch):
    seen = []
    for module in (unified, modeling):
        monkeypatch.setattr(module, "written", lambda df: (seen.append(len(df.columns)), df.sparkSession.createDataFrame([], df.schema))[1])
    return seen


def test_model_frame_writes_prices_only(spark, sf, widths):
    assert len(modeling._model_frame(spark, sf).columns) > 150
    assert widths == [7]


def test_merged_dataset_writes_what_lies_under_its_features(spark, sf, widths, monkeypatch):
    monkeypatch.setattr(clean, "column_gaps", lambda *a: ([], []))
    assert len(modeling._unified(spark, sf)[0].columns) == 84
    assert widths and max(widths) < 25


def test_gaps_and_sparse_columns(spark):
    rows = [(k, dt.date(2024, 1, i + 1), a, b, c) for k in "AB" for i, (a, b, c) in enumerate([(None, 1.0, None), (1.0, None, None), (2.0, 3.0, 4.0 if k == "A" else None)])]
    df = spark.createDataFrame(rows, "symbol string, ts date, a double, b double, c double")
    assert clean.column_gaps(df, ["a", "b", "c"], keep=("symbol", "ts")) == (["b"], ["c"])
    assert clean.gap_columns(df, ["a", "b", "c"]) == ["b"]


def test_report_measures_the_wide_rows_where_they_lie(spark, sf, widths, monkeypatch):
    monkeypatch.setattr(clean, "column_gaps", lambda *a: ([], []))
    plans = []

    def measured(df, columns, keys, aggs):
        plans.append(df.groupBy(*keys).agg(*aggs)._jdf.queryExecution().executedPlan().toString())
        raise StopIteration

    monkeypatch.setattr(validation, "_together", measured, raising=False)
    with pytest.raises(StopIteration):
        modeling._unified(spark, sf, now="2030-01-01", report=True)
    assert max(widths) < 25  # the 84 finished columns are not stored
    assert plans[0].count("Exchange") == 1  # that of the rows under them


def test_one_pass_finds_what_several_find(spark):
    """Copies, outliers and gaps of wide rows, with NULL, copies in the cheap columns alone, and a dataset without any."""
    base = dt.date(2024, 1, 1)
    rows = [(k, base + dt.timedelta(days=i * 2 if k == "B" and i > 20 else i), i % 7 if k != "C" else i, None if i % 9 == 0 else 500.0 if i % 17 == 0 else float(i % 5)) for k in "ABC" for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, ts date, a int, b double")
    asked = dict(derived=False, now="2030-01-01")
    for got, want in zip(validation.validate_unified(df, cheap=["a"], **asked), validation.validate_unified(df, **asked), strict=True):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    found = {(r["symbol"], r["category"]) for r in validation.validate_unified(df, cheap=["a"], **asked)[0].collect()}
    assert {("A", "duplicates"), ("B", "duplicates"), ("A", "outliers"), ("B", "time_series")} <= found and ("C", "duplicates") not in found


def test_scaling_makes_its_bars_once(spark, sf, monkeypatch):
    made = []
    real = modeling.fx.bars
    monkeypatch.setattr(modeling, "written", lambda df: (made.append(len(df.columns)), df.cache())[1])
    monkeypatch.setattr(modeling.fx, "bars", lambda *a: (made.append("bars"), real(*a))[1])
    plan = modeling.feature_scaling(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert made == ["bars", 7] and "InMemoryTableScan" in plan
