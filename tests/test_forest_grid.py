"""Trees that hold all sizes of a grid, and the whole work of the forest and the ensemble."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.functions import trees
from panelmill.operators import ml
from panelmill.plans import modeling


def brute_tree(x, y, w, subset_all, least, depth):
    """Best splits over all features by trying every one."""
    rows = w > 0
    if depth and w[rows].sum() >= 2 * least:
        best, mean = (1e-12, None), np.average(y[rows], weights=w[rows])
        for f in range(x.shape[1]):
            for s in range(trees.BINS - 1):
                a, b = rows & (x[:, f] <= s), rows & (x[:, f] > s)
                if w[a].sum() >= least and w[b].sum() >= least:
                    gain = sum(w[p].sum() * (np.average(y[p], weights=w[p]) - mean) ** 2 for p in (a, b))
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, s))
        if best[1]:
            f, s = best[1]
            left, right = (brute_tree(x, y, np.where(side, w, 0), subset_all, least, depth - 1) for side in (x[:, f] <= s, x[:, f] > s))
            return lambda o: np.where(o[:, f] <= s, left(o), right(o))
    m = np.average(y[rows], weights=w[rows])
    return lambda o: np.full(len(o), m)


@pytest.mark.parametrize(("least", "nodes", "block"), [(1, 128, 100_000), (4, 1, 7)])
def test_a_tree_holds_its_smaller_ones(monkeypatch, least, nodes, block):
    monkeypatch.setattr(trees, "NODES", nodes)
    monkeypatch.setattr(trees, "ROWS", block)
    r = np.random.default_rng(5)
    x, other = r.integers(0, 6, (60, 3)).astype(np.uint8), r.integers(0, 6, (40, 3)).astype(np.uint8)
    y, w = r.normal(size=60) + 100, r.poisson(1.0, 60)
    got = dict(trees.tree_path(x, y, w, other, 3, least, [1, 3, 30], r))
    for depth, p in got.items():
        assert p == pytest.approx(brute_tree(x, y, w, 3, least, depth)(other)), depth


def test_subsets_and_bins():
    assert [trees.subset_size(s, 50) for s in ("sqrt", "log2", "0.3", "all", "auto", "onethird", "7")] == [8, 6, 15, 50, 17, 17, 7]
    f = trees._chosen(2000, 10, 3, np.random.default_rng(1))
    assert all(len(set(t)) == 3 for t in f.tolist()) and np.bincount(f.ravel(), minlength=10).min() > 450
    assert trees.binned(np.array([[1.0], [2.0], [2.5], [9.0]]), [np.array([1.0, 2.0, 3.0])]).ravel().tolist() == [0, 1, 2, 3]


def grid_frame(spark):
    r = np.random.default_rng(7)
    rows = [(int(t), float(a), float(b), None if i % 50 == 0 else float(math.sin(a) + 0.1 * r.normal())) for i, (t, a, b) in enumerate(zip(r.integers(0, 40, 800), r.normal(size=800), r.normal(size=800), strict=True))]
    return spark.createDataFrame(rows, "ts int, a double, b double, target double").repartition(3)


def test_a_grid_scores_every_set_on_every_fold(spark, monkeypatch):
    monkeypatch.setattr(ml, "TREES_PER_TASK", 4)
    monkeypatch.setattr(ml, "ROWS_PER_BLOCK", 50)
    df = grid_frame(spark)
    grid = {"numTrees": [3, 10], "maxDepth": [1, 6], "minInstancesPerNode": [1, 8], "featureSubsetStrategy": ["all"]}
    got = ml.grid_search(df, ml.fit_forest, grid, ["a", "b"])
    assert len(got) == 8 and [r["rmse"] for r in got] == sorted(r["rmse"] for r in got)
    # by hand, from one tree after another
    rows, folds, want = df.na.drop().toPandas(), ml.time_folds(df, 3), {}
    assert len(folds) == 3
    whole = {(r["numTrees"], r["maxDepth"], r["minInstancesPerNode"]): r["rmse"] for r in got}
    base = [float(((t["target"] - rows[rows["ts"] < lo]["target"].mean()) ** 2).mean() ** 0.5) for lo, hi in folds for t in [rows[rows["ts"].between(lo, hi)]]]
    assert whole[10, 6, 1] < 0.5 * whole[10, 1, 1] < 0.5 * sum(base) / 3 * 1.1
    # a set alone is scored as it is among others: nothing but its own trees and levels counts
    for n, d, least in ((3, 6, 8), (10, 1, 1)):
        alone = ml.grid_search(df, ml.fit_forest, {"numTrees": [n], "maxDepth": [d], "minInstancesPerNode": [least], "featureSubsetStrategy": ["all"]}, ["a", "b"])
        want[n, d, least] = alone[0]["rmse"]
        assert whole[n, d, least] == pytest.approx(want[n, d, least], rel=1e-12)
    # close to forests fitted by Spark
    fitted = ml.grid_search(df, lambda *a, **k: ml.fit_forest(*a, **k), {k: v[-1:] for k, v in grid.items()}, ["a", "b"])[0]["rmse"]
    assert whole[10, 6, 8] == pytest.approx(fitted, rel=0.25)


def test_the_queries_do_their_whole_work(spark, monkeypatch):
    """The forest searches the default grid on three folds, the ensemble grows the default number of trees and rounds."""
    frame, asked = grid_frame(spark).selectExpr("'A' symbol", "date_add(date'2020-01-01', ts) ts", "a", "b", "target").na.drop(), {}

    class Stop(Exception):
        pass

    def scores(df, combos, features, target, folds, ts, seed=42):
        asked["sets"], asked["folds"] = len(combos), len(folds)
        raise Stop

    def kept(name):
        def fit(df, features, target="target", seed=42, **params):
            asked[name] = params

        return fit

    monkeypatch.setattr(modeling, "_model_data", lambda *a: (frame, ["a", "b"]))
    monkeypatch.setattr(ml, "_forest_scores", scores, raising=False)
    monkeypatch.setattr(ml, "fit_linear", lambda *a, **k: None)
    with pytest.raises(Stop):
        modeling.ml_forest(spark, "")
    assert asked == {"sets": 108, "folds": 3}
    monkeypatch.setattr(ml, "fit_forest", kept("forest"))
    monkeypatch.setattr(ml, "fit_boosted", kept("boosted"))
    monkeypatch.setattr(ml, "predict_ensemble", lambda m, df: df.select("symbol", "ts", *[F.lit(0.0).alias(c) for c in ("prediction", "prediction_ridge", "prediction_forest", "prediction_boosted")]))
    modeling.ml_ensemble(spark, "")
    assert asked["forest"]["numTrees"] == asked["boosted"]["maxIter"] == 100
