"""Feature scores from one pass over rows with any gaps."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions import moments
from panelmill.operators import ml


def plain_scores(pdf, cols, max_missing):
    """What two aggregates gave: usable columns, then complete rows. NaN is known but not complete."""
    n = len(pdf)
    known = {c: [v for v in pdf[c] if v is not None] for c in cols}
    keep = [c for c in cols if 1 - len(known[c]) / n < max_missing and len({"nan" if math.isnan(v) else v for v in known[c]}) > 1]
    rows = [r for r in pdf[[*keep, "target"]].itertuples(index=False) if all(v is not None and not math.isnan(v) for v in r)]
    x = np.array(rows, float)
    score = {c: np.corrcoef(x[:, i], x[:, -1])[0, 1] ** 2 if x[:, i].std() else 0.0 for i, c in enumerate(keep)}
    return sorted(score.items(), key=lambda s: (-round(s[1], 9), s[0]))


@pytest.mark.parametrize("kinds", [2_000, 1])
def test_feature_scores(spark, monkeypatch, kinds):
    monkeypatch.setattr(moments, "KINDS", kinds)
    r = np.random.default_rng(3)
    n = 400
    cols = [f"f{i}" for i in range(11)]
    pdf = pd.DataFrame({c: r.normal(size=n) + 1e6 for c in cols} | {"target": r.normal(size=n)}).astype(object)
    pdf["f1"] = pdf["target"] * 3.0 + pdf["f0"]
    pdf["f2"] = 5.0  # constant
    pdf.loc[r.random(n) < 0.5, "f3"] = None  # too many missing
    for c, share in (("f4", 0.2), ("f5", 0.1), ("target", 0.05)):
        pdf.loc[r.random(n) < share, c] = None
    pdf["f6"] = [float("nan") if i % 9 == 0 else 4.0 for i in range(n)]  # one value and NaN
    pdf["f7"] = [i % 3 for i in range(n)]
    pdf.loc[:30, "f8"] = None
    schema = ", ".join(f"{c} {'int' if c == 'f7' else 'double'}" for c in pdf.columns)
    rows = [tuple(None if v is None else int(v) if c == "f7" else float(v) for c, v in zip(pdf.columns, t, strict=True)) for t in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, schema).repartition(5)
    got, want = ml.feature_scores(df, cols), plain_scores(pdf, cols, 0.3)
    assert [c for c, _ in got] == [c for c, _ in want] and "f6" in dict(got)
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)
    assert ml.feature_scores(df.limit(0), cols) == [] and ml.feature_scores(df, ["f2"]) == []
    assert ml.feature_scores(df.withColumn("target", F.lit(None).cast("double")), ["f1", "f0"]) == [("f0", 0.0), ("f1", 0.0)]


def test_feature_scores_read_the_features_once(spark, monkeypatch):
    """The wide frame is worked out by the pass that reads it, so there must not be two."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.range(100).selectExpr("cast(id as double) target", "cast(id * id as double) a").mapInArrow(seen, "target double, a double")
    assert [c for c, _ in ml.feature_scores(df, ["a"])] == ["a"]
    assert reads.value == 100
