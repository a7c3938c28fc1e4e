"""Panel regressors on Spark ML: features, selection, scaling, fitting, scoring.

One model is fitted on the whole panel; training never leaves Spark, the
driver only sees coefficients, column statistics and scores.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trees
from ..functions.axis import DAILY, Axis, per_key
from ..functions.moments import ColumnMoments
from ..functions.quantiles import column_quantiles
from ..functions.exprs import numeric_columns, total
from ..session import written
from . import clean
from .evaluate import regression_metrics
from .forecast import forward_return
from .indicators import technical_indicators

C = F.col


# ------------------------------------------------------------ features


def model_frame(df: DataFrame, horizon: int = 1, axis: Axis = DAILY, price: str = "close") -> DataFrame:
    """Indicators, lags, calendar columns and the forward return ``target``."""
    df = technical_indicators(df, axis, price)
    df = clean.model_time_features(clean.model_lag_features(df, axis, price=price), axis.ts)
    return clean.drop_infinite(forward_return(df, horizon, axis, price))


def deep_frame(df: DataFrame, axis: Axis = DAILY) -> DataFrame:
    """Indicators plus quote features, numeric columns only, gaps filled both ways."""
    from .microstructure import microstructure

    df = microstructure(technical_indicators(df, axis), axis)
    cols = numeric_columns(df, axis.key)
    df = df.select(*axis.key, *axis.order, *[c for c in cols if c not in axis.order])
    return clean.back_fill(clean.forward_fill(df, cols, axis), cols, axis)


def feature_columns(df: DataFrame, axis: Axis = DAILY, target: str = "target") -> list[str]:
    return numeric_columns(df, (*axis.key, *axis.order, target))


def with_missing_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features a model expects but the data lacks become 0."""
    have = set(df.columns)
    return df.withColumns({c: F.lit(0.0) for c in features if c not in have})


def feature_scores(df: DataFrame, cols: Sequence[str], target: str = "target", max_missing: float = 0.3) -> list[tuple[str, float]]:
    """Usable columns with their squared correlation to the target, best first.

    The univariate F statistic grows with the squared correlation, so the
    order is the same; scores equal to nine digits go by name.  One pass over
    the data, in Arrow batches; no rows are collected.
    """
    found = ColumnMoments(df, C(target), [C(c) for c in cols])
    n, known, varied = found.counts()
    at = [i for i in range(1, len(cols) + 1) if n and 1 - known[i] / n < max_missing and varied[i]]
    if not at:
        return []
    whole = found.whole(at)
    if whole is None or whole.n < 2:
        return sorted((cols[i - 1], 0.0) for i in at)
    _, _, _, _, m2, cross = whole.fields
    scored = [(cols[i - 1], float(cross[i] ** 2 / (m2[i] * m2[0])) if m2[i] * m2[0] else 0.0) for i in at]
    return sorted(scored, key=lambda s: (-round(s[1], 9), s[0]))


def select_features(df: DataFrame, cols: Sequence[str], target: str = "target", k: int = 50, max_missing: float = 0.3) -> list[str]:
    return [c for c, _ in feature_scores(df, cols, target, max_missing)[:k]]


def impute(df: DataFrame, cols: Sequence[str], axis: Axis = DAILY) -> DataFrame:
    """Forward, backward, then the series median; rows still incomplete are dropped."""
    df = clean.fill_both(df, cols, axis)
    df = per_key(df, axis, {f"_m_{c}": F.percentile(c, F.lit(0.5)) for c in cols})
    return df.withColumns({c: F.coalesce(C(c), C(f"_m_{c}")) for c in cols}).drop(*[f"_m_{c}" for c in cols]).na.drop(subset=list(cols))


# ------------------------------------------------------------ scaling


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "standard") -> dict[str, tuple[float, float]]:
    """Centre and spread per column: 'standard', 'minmax', 'robust' (exact quartiles) or 'none'."""
    if kind == "none":
        return {c: (0.0, 1.0) for c in cols}
    if kind == "robust":
        q = column_quantiles(df, [], list(cols), {"a": 0.25, "m": 0.5, "b": 0.75})
        got = {r["column"]: (r["m"], r["b"] - r["a"]) for r in q.collect()}  # one row per column
    else:
        pair = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, F.max)}[kind]
        row = df.agg(*[f(C(c).cast("double")).alias(f"{i}_{j}") for i, c in enumerate(cols) for j, f in enumerate(pair)]).first()
        got = {c: (row[f"{i}_0"], row[f"{i}_1"] - (row[f"{i}_0"] if kind == "minmax" else 0.0)) for i, c in enumerate(cols)}
    return {c: (m, s if s else 1.0) for c, (m, s) in got.items()}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (C(c) - m) / s for c, (m, s) in scaler.items()})


# ------------------------------------------------------------ models


def _assembled(features: Sequence[str], degree: int = 1) -> list:
    stages = [VectorAssembler(inputCols=list(features), outputCol="features" if degree == 1 else "_raw", handleInvalid="skip")]
    if degree > 1:
        stages.append(PolynomialExpansion(degree=degree, inputCol="_raw", outputCol="features"))
    return stages


def fit_linear(df: DataFrame, features: Sequence[str], target: str = "target", penalty: str = "none", alpha: float = 1.0, l1_ratio: float = 0.5, degree: int = 1) -> PipelineModel:
    """Least squares, ridge, lasso or elastic net.

    Loss: summed squares + alpha*|w|^2 for ridge; mean squares / 2 + alpha *
    (l1_ratio*|w| + (1 - l1_ratio)/2*|w|^2) for lasso and elastic.  Spark fits
    on the target divided by its deviation, which leaves an absolute penalty
    as it is but divides a squared one by the deviation; that is undone here.
    """
    df = df.na.drop(subset=[*features, target])
    l1, l2 = 0.0, 0.0
    if penalty == "lasso":
        l1 = alpha
    elif penalty == "elastic":
        l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    elif penalty not in ("none", "ridge"):
        raise ValueError(f"unknown penalty: {penalty}")
    if penalty in ("ridge", "elastic"):
        # the normal-equation solver uses the population deviation, the iterative one the sample deviation
        spread = F.stddev_samp if l1 else F.stddev_pop
        stats = df.agg(F.count(F.lit(1)).alias("n"), spread(target).alias("s")).first()
        l2 = (alpha / max(stats["n"], 1) if penalty == "ridge" else l2) * (stats["s"] or 1.0)
    reg = l1 + l2
    lr = LinearRegression(
        labelCol=target, standardization=False, regParam=reg, elasticNetParam=l1 / reg if reg else 0.0, solver="l-bfgs" if l1 else "normal", maxIter=200, tol=1e-12
    )
    return Pipeline(stages=[*_assembled(features, degree), lr]).fit(df)


def fit_forest(df: DataFrame, features: Sequence[str], target: str = "target", seed: int = 42, **params) -> PipelineModel:
    rf = RandomForestRegressor(labelCol=target, seed=seed, **params)
    return Pipeline(stages=[*_assembled(features), rf]).fit(df.na.drop(subset=[*features, target]))


def fit_boosted(df: DataFrame, features: Sequence[str], target: str = "target", seed: int = 42, **params) -> PipelineModel:
    gbt = GBTRegressor(labelCol=target, seed=seed, **params)
    return Pipeline(stages=[*_assembled(features), gbt]).fit(df.na.drop(subset=[*features, target]))


def predict(model: PipelineModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    scored = model.transform(df).drop("features", "_raw")
    return scored if out == "prediction" else scored.withColumnRenamed("prediction", out)


def time_folds(df: DataFrame, splits: int = 3, ts: str = "ts") -> list[tuple[object, object]]:
    """(start, end) of each test block for expanding-window validation; blocks hold equal numbers of times."""
    times = df.select(ts).distinct()  # one row per calendar time
    bucket = F.ntile(splits + 1).over(Window.orderBy(ts))
    starts = times.withColumn("b", bucket).groupBy("b").agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).orderBy("b").collect()
    return [(r["lo"], r["hi"]) for r in starts[1:]]


# The default grid of a forest (30 is the deepest tree Spark grows). Spark has no parameter for the rows
# needed to split a node; the rows needed in each child stand for both.
FOREST_GRID = {
    "numTrees": [50, 100, 200],
    "maxDepth": [5, 10, 15, 30],
    "minInstancesPerNode": [1, 2, 4],
    "featureSubsetStrategy": ["sqrt", "log2", "0.3"],
}
TREES_PER_TASK = 50
ROWS_PER_BLOCK = 50_000  # test rows whose sums travel in one row


def grid_search(df: DataFrame, fit, grid: dict[str, Sequence] | None, features: Sequence[str], target: str = "target", splits: int = 3, ts: str = "ts", parallelism: int = 4) -> list[dict]:
    """Mean rmse of every parameter set over expanding time folds, best first.  Without a grid: ``FOREST_GRID``.

    The sets of a forest that differ in depth or number of trees only share one forest (``_forest_scores``).
    """
    grid = FOREST_GRID if grid is None else grid
    folds = time_folds(df, splits, ts)
    combos = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    if fit is fit_forest and set(grid) <= set(FOREST_GRID):
        by_combo = _forest_scores(df, combos, features, target, folds, ts)
    else:
        data = df.select(ts, target, *features).persist()
        try:

            def one(job):
                params, (lo, hi) = job
                model = fit(data.filter(C(ts) < F.lit(lo)), features, target, **params)
                test = predict(model, data.filter(C(ts).between(F.lit(lo), F.lit(hi))))
                return regression_metrics(test, (), target).first()["rmse"]

            jobs = [(p, f) for p in combos for f in folds]
            with ThreadPool(parallelism) as pool:
                scores = pool.map(one, jobs)
        finally:
            data.unpersist()
        by_combo = [scores[i * len(folds) : (i + 1) * len(folds)] for i in range(len(combos))]
    out = [{**p, "rmse": sum(s) / len(s)} for p, s in zip(combos, by_combo)]
    return sorted(out, key=lambda r: r["rmse"])


def _forest_scores(df: DataFrame, combos: Sequence[dict], features: Sequence[str], target: str, folds: Sequence[tuple], ts: str, seed: int = 42) -> list[list[float]]:
    """Rmse per parameter set and fold, every set with all its trees.

    Per fold, subset strategy and least instances one forest of the most trees is grown to the greatest depth; smaller ones are
    its first trees and its upper levels.  A task grows up to ``TREES_PER_TASK`` trees on all training rows, which it holds
    as one byte per feature, and takes the test rows down with them; sums of their predictions are put together by Spark.
    """
    full = [{"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 1, "featureSubsetStrategy": "auto", **p} for p in combos]
    sizes, depths = sorted({p["numTrees"] for p in full}), sorted({p["maxDepth"] for p in full})
    forests = sorted({(p["featureSubsetStrategy"], p["minInstancesPerNode"]) for p in full})
    edges = sorted({0, *sizes, *range(0, sizes[-1], TREES_PER_TASK)})
    part = total([(C(ts) >= F.lit(lo)).cast("int") for lo, _ in folds])  # test rows of fold i are part i + 1, training rows all before
    rows = df.select(part.alias("part"), C(target).cast("double").alias("y"), *[C(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    rows = written(rows.na.drop())
    names = rows.columns[2:]
    parts = []
    for i in range(len(folds)):
        quantiles = rows.filter(C("part") <= i).approxQuantile(names, [q / trees.BINS for q in range(1, trees.BINS)], 0.001)
        if not quantiles or not quantiles[0]:
            raise ValueError("a fold has no training rows")
        cuts = [np.unique(q) for q in quantiles]
        for (strategy, least), (first, last) in itertools.product(forests, itertools.pairwise(edges)):
            grown = _grown(cuts, i, trees.subset_size(strategy, len(features)), least, depths, range(first, last), seed)
            found = rows.filter(C("part") <= i + 1).coalesce(1).mapInArrow(grown, "depth int, block long, y binary, s binary")
            parts.append(found.select(F.lit(i).alias("fold"), F.lit(strategy).alias("strategy"), F.lit(least).alias("least"), F.lit(first).alias("first"), F.lit(last).alias("last"), "*"))
    sums = functools.reduce(DataFrame.unionAll, parts)

    def scored(key, pdf):
        pdf = pdf.sort_values("first")
        y, s, out = np.frombuffer(pdf["y"].iloc[0]), 0.0, []
        for last, more in zip(pdf["last"], pdf["s"], strict=True):
            s = s + np.frombuffer(more)
            if last in sizes:
                out.append((*key[:4], int(last), float(((y - s / last) ** 2).sum()), len(y)))
        return pd.DataFrame(out, columns=["fold", "strategy", "least", "depth", "trees", "sse", "n"])

    errors = sums.groupBy("fold", "strategy", "least", "depth", "block").applyInPandas(scored, "fold int, strategy string, least int, depth int, trees int, sse double, n long")
    rmse = errors.groupBy("fold", "strategy", "least", "depth", "trees").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))
    got = {tuple(r)[:5]: r["rmse"] for r in rmse.collect()}  # one row per parameter set and fold
    return [[got[i, p["featureSubsetStrategy"], p["minInstancesPerNode"], p["maxDepth"], p["numTrees"]] for i in range(len(folds))] for p in full]


def _grown(cuts: list[np.ndarray], fold: int, subset: int, least: int, depths: Sequence[int], which: range, seed: int):
    """Task that grows the trees ``which`` of a forest and gives, per depth and block of test rows, their targets and sums of predictions."""

    def run(batches):
        bins, ys, where = [], [], []
        for b in batches:
            where.append(b.column(0).to_numpy() == fold + 1)
            ys.append(b.column(1).to_numpy())
            bins.append(trees.binned(np.stack([b.column(i).to_numpy() for i in range(2, b.num_columns)], 1), cuts) if b.num_rows else np.zeros((0, len(cuts)), np.uint8))
        if not bins:
            return
        test, y, x = np.concatenate(where), np.concatenate(ys), np.concatenate(bins)
        bins.clear()
        other, wanted, x, y = x[test], y[test], x[~test], y[~test]
        sums = {d: np.zeros(len(other)) for d in depths}
        for t in which:
            rng = np.random.default_rng([seed, t])
            for d, p in trees.tree_path(x, y, rng.poisson(1.0, len(y)), other, subset, least, depths, rng):
                sums[d] += p
        for d, s in sums.items():
            for i, a in enumerate(range(0, len(s), ROWS_PER_BLOCK)):
                one = [d], [i], [wanted[a : a + ROWS_PER_BLOCK].tobytes()], [s[a : a + ROWS_PER_BLOCK].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(one, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["depth", "block", "y", "s"])

    return run


def fit_ensemble(df: DataFrame, features: Sequence[str], target: str = "target", seed: int = 42, trees: int = 100) -> dict[str, PipelineModel]:
    """Ridge, forest and boosted trees (as many rounds as the forest has trees), to be averaged by ``predict_ensemble``."""
    return {
        "ridge": fit_linear(df, features, target, "ridge"),
        "forest": fit_forest(df, features, target, seed, numTrees=trees, maxDepth=5),
        "boosted": fit_boosted(df, features, target, seed, maxIter=trees, maxDepth=3),
    }


def predict_ensemble(models: dict[str, PipelineModel], df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Member predictions as columns and their (weighted) mean."""
    w = weights or {n: 1.0 for n in models}
    for name, m in models.items():
        df = predict(m, df, f"prediction_{name}")
    mean = total([C(f"prediction_{n}") * float(w[n]) for n in models]) / float(sum(w[n] for n in models))
    return df.withColumn("prediction", mean)


def feature_importance(model: PipelineModel, features: Sequence[str], top: int | None = None) -> list[tuple[str, float]]:
    """Tree importances or absolute coefficients, largest first."""
    last = model.stages[-1]
    values = (last.featureImportances if hasattr(last, "featureImportances") else last.coefficients).toArray()
    ranked = sorted(((f, abs(float(v))) for f, v in zip(features, values)), key=lambda x: (-x[1], x[0]))
    return ranked[:top]


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


#: model factory by name
BUILDERS = {
    "linear": fit_linear,
    "ridge": lambda d, f, t="target", **k: fit_linear(d, f, t, "ridge", **k),
    "lasso": lambda d, f, t="target", **k: fit_linear(d, f, t, "lasso", **k),
    "elastic": lambda d, f, t="target", **k: fit_linear(d, f, t, "elastic", **k),
    "polynomial": lambda d, f, t="target", **k: fit_linear(d, f, t, **{"penalty": "ridge", "degree": 2, **k}),
    "forest": fit_forest,
    "boosted": fit_boosted,
}


def build(name: str, df: DataFrame, features: Sequence[str], target: str = "target", **params) -> PipelineModel:
    if name not in BUILDERS:
        raise ValueError(f"unknown model: {name}")
    return BUILDERS[name](df, features, target, **params)
