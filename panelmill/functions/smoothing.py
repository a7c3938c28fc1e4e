"""Forecasters over arrays of past values, many rows of an Arrow batch at once.

Spark deals the arrays to tasks, one series or stretch of folds a row; a task takes them in blocks and walks along time once for all rows
and all parameter sets of a block, so that a step costs a few numpy operations on (rows x sets) numbers. Sums run in order of
time, one value after the other. A missing value is NaN here and NULL in the table; what depends on it is missing as well.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

STEPS = (0.1, 0.3, 0.5, 0.7, 0.9)
HOLT_GRID = tuple(itertools.product(STEPS, (0.01, 0.1, 0.3), (0.0,)))  # level, trend, season
SEASONAL_GRID = tuple(itertools.product(STEPS, (0.01, 0.1, 0.3), (0.1, 0.5)))
THETA_GRID = tuple(0.05 + 0.9 * i / 18 for i in range(19))
KNOWN = ("exp_smoothing", "theta", "naive", "ensemble")
BLOCK = 512  # rows walked together: their state stays in the processor's cache


def check_models(models: Sequence[str]) -> None:
    if set(models) - set(KNOWN):
        raise ValueError(f"unknown models: {sorted(set(models) - set(KNOWN))}")


def _best(sse: np.ndarray) -> np.ndarray:
    """Least squared error by row; the first set on ties."""
    return np.argmin(sse, axis=1)


class _Rows:
    """Arrays of one block, the longest first: value ``i`` of the rows that reach so far is ``at(i)``."""

    def __init__(self, arrays: Sequence[np.ndarray]):
        self.n = np.array([len(a) for a in arrays])
        self.y = np.full((self.n.max(), len(arrays)), np.nan)
        for r, a in enumerate(arrays):
            self.y[: len(a), r] = a
        self.alive = np.array([(self.n > i).sum() for i in range(len(self.y))])
        self.rows = np.arange(len(arrays))

    def at(self, i: int) -> np.ndarray:
        return self.y[i, : self.alive[i], None]

    def back(self, k: np.ndarray | int) -> np.ndarray:
        """The value ``k`` places from the end (1: the last)."""
        return self.y[self.n - k, self.rows]


def _walk_holt(b: _Rows, sp: int, grid: np.ndarray, errors: bool = False):
    """Additive smoothing. ``grid``: (sets, 3), or (rows, 1, 3) for one set a row. Returns (sse, level, trend, season, errors)."""
    a, beta, c = grid[..., 0], grid[..., 1], grid[..., 2]
    slope, turn = np.broadcast_to(a * beta, (len(b.n), a.shape[-1])), np.broadcast_to(c * (1 - a), (len(b.n), a.shape[-1]))
    a = np.broadcast_to(a, slope.shape)
    if sp > 1:
        mean, after = sum(b.y[i] for i in range(sp)) / sp, sum(b.y[sp + i] for i in range(sp)) / sp
        level, trend = mean, (after - mean) / sp
        season = [np.repeat((b.y[i] - mean)[:, None], slope.shape[1], axis=1) for i in range(sp)]
    else:
        level, season = b.y[0], []
        trend = np.nan_to_num(b.y[1] - b.y[0], nan=0.0) if len(b.y) > 1 else np.zeros(len(b.n))
    level, trend = (np.repeat(x[:, None], slope.shape[1], axis=1) for x in (level, trend))
    sse, first = np.zeros(slope.shape), 0 if sp > 1 else 1
    kept = np.full((len(b.y), len(b.n)), np.nan) if errors else None
    ahead, e, part = (np.empty(slope.shape) for _ in range(3))
    for i in range(first, len(b.y)):
        k = b.alive[i]
        h, d, t = ahead[:k], e[:k], part[:k]
        np.add(level[:k], trend[:k], out=h)
        if sp > 1:
            s = season[i % sp][:k]
            np.add(h, s, out=d)
            np.subtract(b.at(i), d, out=d)
            s += np.multiply(turn[:k], d, out=t)
        else:
            np.subtract(b.at(i), h, out=d)
        np.multiply(a[:k], d, out=t)
        np.add(h, t, out=level[:k])
        trend[:k] += np.multiply(slope[:k], d, out=t)
        sse[:k] += np.multiply(d, d, out=t)
        if errors:
            kept[i, :k] = d[:, 0]
    return sse, level, trend, season, kept


def _walk_theta(b: _Rows, a: np.ndarray, errors: bool = False):
    """Simple smoothing. ``a``: (sets,), or (rows, 1). Returns (sse, level, errors)."""
    a = np.broadcast_to(a, (len(b.n), a.shape[-1]))
    level, sse = np.repeat(b.y[0][:, None], a.shape[1], axis=1), np.zeros(a.shape)
    kept = np.full((len(b.y), len(b.n)), np.nan) if errors else None
    e, part = np.empty(a.shape), np.empty(a.shape)
    for i in range(len(b.y)):
        k = b.alive[i]
        d, t = e[:k], part[:k]
        np.subtract(b.at(i), level[:k], out=d)
        sse[:k] += np.multiply(d, d, out=t)
        level[:k] += np.multiply(a[:k], d, out=t)
        if errors:
            kept[i, :k] = d[:, 0]
    return sse, level, kept


def _slope(b: _Rows) -> np.ndarray:
    """Least-squares slope over 0, 1, 2..."""
    top, squares, mid = np.zeros(len(b.n)), np.zeros(len(b.n)), (b.n - 1) / 2
    for i in range(len(b.y)):
        k = b.alive[i]
        t = i - mid[:k]
        top[:k] += b.y[i, :k] * t
        squares[:k] += t * t
    return top / np.maximum(squares, 1e-12)


def _spread(errors: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Sample deviation of the ``known`` places of each column, 0 with fewer than two."""
    n = known.sum(axis=0)
    mean = np.divide(np.where(known, errors, 0.0).sum(axis=0), n, out=np.zeros(len(n)), where=n > 0)
    off = np.where(known, errors - mean, 0.0)
    return np.where(n > 1, np.sqrt((off * off).sum(axis=0) / np.maximum(n - 1, 1)), 0.0)


def _fit_block(arrays: Sequence[np.ndarray], models: Sequence[str], horizon: int, sp: int, naive_sp: int, bands: bool):
    """{model: (paths (rows, horizon), sigma (rows,) or None)} of arrays sorted by falling length."""
    b = _Rows(arrays)
    many, ahead, place = "ensemble" in models, np.arange(1, horizon + 1), np.arange(len(b.y))[:, None]
    paths: dict[str, np.ndarray] = {}
    errors: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # errors by (place, row), first place that has one
    if many or "exp_smoothing" in models:
        grid = np.array(SEASONAL_GRID if sp > 1 else HOLT_GRID)
        sse, level, trend, season, _ = _walk_holt(b, sp, grid)
        best = _best(sse)
        pick = lambda x: x[b.rows, best][:, None]
        paths["exp_smoothing"] = pick(level) + ahead * pick(trend)
        if sp > 1:
            turn = np.stack([pick(s)[:, 0] for s in season], axis=1)
            paths["exp_smoothing"] = paths["exp_smoothing"] + turn[b.rows[:, None], (b.n[:, None] - 1 + ahead) % sp]
        if bands:
            errors["exp_smoothing"] = _walk_holt(b, sp, grid[best][:, None, :], errors=True)[4], 0 if sp > 1 else 1
    if many or "theta" in models:
        grid = np.array(THETA_GRID)
        sse, level, _ = _walk_theta(b, grid)
        best = _best(sse)
        a, n = grid[best][:, None], b.n[:, None]
        paths["theta"] = level[b.rows, best][:, None] + 0.5 * _slope(b)[:, None] * (ahead - 1 + (1 - np.power(1 - a, n)) / a)
        if bands:
            errors["theta"] = _walk_theta(b, a, errors=True)[2], 1
    if many or "naive" in models:
        paths["naive"] = np.stack([b.back(naive_sp - (k - 1) % naive_sp) for k in ahead], axis=1)
        if bands:
            before = np.full(b.y.shape, np.nan)
            before[naive_sp:] = b.y[naive_sp:] - b.y[:-naive_sp] if len(b.y) > naive_sp else before[naive_sp:]
            errors["naive"] = before, naive_sp
    if many:
        paths["ensemble"] = (paths["exp_smoothing"] + paths["theta"] + paths["naive"]) / 3
        if bands:
            parts = [errors[m] for m in ("exp_smoothing", "theta", "naive")]
            errors["ensemble"] = (parts[0][0] + parts[1][0] + parts[2][0]) / 3, max(p[1] for p in parts)
    within = place < b.n
    return {m: (paths[m], _spread(errors[m][0], within & (place >= errors[m][1])) if bands else None) for m in models}


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The arrays of a list column, NULL as NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]


def _doubles(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), from_pandas=True)  # NaN becomes NULL


def _fit_batch(batch: pa.RecordBatch, models: Sequence[str], horizon: int, sp: int, y: str, bands: bool) -> pa.Array:
    arrays = _lists(batch.column(y))
    n = np.array([len(a) for a in arrays], dtype=np.int64)
    rows, m = len(arrays), len(models)
    paths, sigma = np.full((rows, m, horizon), np.nan), np.full((rows, m), np.nan)
    # a season or none is a matter of the row: smoothing needs two rounds of values, the naive model one
    kinds = [(n >= 2 * sp, sp, sp), ((n >= sp) & (n < 2 * sp), 1, sp), (n < sp, 1, 1)] if sp > 1 else [(n > 0, 1, 1)]
    for chosen, smooth_sp, naive_sp in kinds:
        order = np.flatnonzero(chosen)
        order = order[np.argsort(-n[order], kind="stable")]
        for at in range(0, len(order), BLOCK):
            part = order[at : at + BLOCK]
            done = _fit_block([arrays[r] for r in part], models, horizon, smooth_sp, naive_sp, bands)
            for i, name in enumerate(models):
                paths[part, i], spread = done[name]
                if bands:
                    sigma[part, i] = spread
    each = np.arange(rows * m + 1, dtype=np.int32)
    fields = [pa.array(list(models) * rows, pa.string()), pa.ListArray.from_arrays(each * horizon, _doubles(paths.ravel())), _doubles(sigma.ravel())]
    return pa.ListArray.from_arrays(each[::m][: rows + 1], pa.StructArray.from_arrays(fields, ["model", "path", "sigma"]))


FIT = T.ArrayType(T.StructType([T.StructField("model", T.StringType()), T.StructField("path", T.ArrayType(T.DoubleType())), T.StructField("sigma", T.DoubleType())]))


def fitted(df: DataFrame, models: Sequence[str], horizon: int, sp: int = 1, y: str = "y", bands: bool = True) -> DataFrame:
    """Rows with an array ``y`` of at least one value; in its place ``fits``: an array of (model, path, sigma) for the models asked for.

    ``path`` is the forecast of ``horizon`` steps, ``sigma`` the deviation of the one-step errors (NULL without ``bands``).
    A season needs two rounds of values in ``y`` for smoothing, one for the naive model; shorter arrays do without.
    """
    check_models(models)
    models = list(models)
    keep = [f for f in df.schema.fields if f.name != y]
    names = [f.name for f in keep]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], _fit_batch(batch, models, horizon, sp, y, bands)], [*names, "fits"])

    return df.mapInArrow(fit, T.StructType([*keep, T.StructField("fits", FIT)]))


# ------------------------------------------------------------ folds

METRICS = (
    "mse", "mae", "rmse", "smape", "direction_accuracy", "correlation", "mean_actual", "mean_predicted", "std_actual", "std_predicted", "prediction_bias",
)


def window_metrics(a: np.ndarray, p: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The figures of ``evaluate.forecast_metrics`` by row, over the places where both are known, and their number."""
    ok = ~(np.isnan(a) | np.isnan(p))
    n = ok.sum(axis=1)
    a, p, k = np.where(ok, a, 0.0), np.where(ok, p, 0.0), np.maximum(n, 1)
    mean = lambda x: x.sum(axis=1) / k
    e = a - p
    ma, mp = mean(a), mean(p)
    da, dp = np.where(ok, a - ma[:, None], 0.0), np.where(ok, p - mp[:, None], 0.0)
    sa, sb = (da * da).sum(axis=1), (dp * dp).sum(axis=1)
    flat = lambda x: np.where(ok, x, np.inf).min(axis=1) == np.where(ok, x, -np.inf).max(axis=1)
    both = np.sqrt(sa) * np.sqrt(sb)
    still = flat(a) | flat(p) | (both == 0)
    half = np.maximum((np.abs(a) + np.abs(p)) / 2, 1e-8)
    mse, mae = mean(e * e), mean(np.abs(e))
    out = (
        mse, mae, np.sqrt(mse), mean(np.abs(e) / half) * 100, mean(((a > 0) == (p > 0)) & ok) * 100,
        np.where(still, 0.0, (da * dp).sum(axis=1) / np.where(both == 0, 1.0, both)), ma, mp, np.sqrt(sa / k), np.sqrt(sb / k), mp - ma,
    )
    return dict(zip(METRICS, out)), n


def fold_metrics(df: DataFrame, models: Sequence[str], horizon: int, step: int, sp: int = 1) -> DataFrame:
    """Rows (keys..., y, _w, _first): stretches of series whose folds begin every ``step`` values, numbered from ``_first``, with
    ``_w`` values to learn from and ``horizon`` to test.  Returns (keys..., fold, model, metrics...), one row a fold and model.
    """
    check_models(models)
    models = list(models)
    keep = [f for f in df.schema.fields if f.name not in ("y", "_w", "_first")]
    names = [f.name for f in keep]
    fields = [*keep, T.StructField("fold", T.LongType()), T.StructField("model", T.StringType())]
    fields += [*[T.StructField(c, T.DoubleType()) for c in METRICS], T.StructField("num_samples", T.LongType())]

    def score(batch: pa.RecordBatch, windows: np.ndarray, rows: np.ndarray, folds: np.ndarray) -> Iterator[pa.RecordBatch]:
        past, actual = windows[:, : windows.shape[1] - horizon], windows[:, windows.shape[1] - horizon :]
        n = past.shape[1]
        smooth_sp, naive_sp = (sp if n >= 2 * sp else 1, sp if n >= sp else 1) if sp > 1 else (1, 1)
        done = _fit_block(past, models, horizon, smooth_sp, naive_sp, False)
        for m in models:
            figures, known = window_metrics(actual, done[m][0])
            some = known > 0
            keys = [batch.column(c).take(pa.array(rows[some])) for c in names]
            cols = [pa.array(folds[some]), pa.array([m] * int(some.sum()), pa.string()), *[_doubles(figures[c][some]) for c in METRICS], pa.array(known[some])]
            yield pa.RecordBatch.from_arrays([*keys, *cols], [f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = _lists(batch.column("y"))
            width, first = batch.column("_w").to_numpy(), batch.column("_first").to_numpy()
            # windows of one length are walked together
            for w in np.unique(width):
                held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                size = 0
                for r in np.flatnonzero(width == w):
                    cut = np.lib.stride_tricks.sliding_window_view(arrays[r], w + horizon)[::step]
                    held.append((cut, np.full(len(cut), r), first[r] + np.arange(len(cut), dtype=np.int64)))
                    size += len(cut)
                    if size >= BLOCK:
                        yield from score(batch, *[np.concatenate(x) for x in zip(*held)])
                        held, size = [], 0
                if held:
                    yield from score(batch, *[np.concatenate(x) for x in zip(*held)])

    return df.mapInArrow(run, T.StructType(fields))
