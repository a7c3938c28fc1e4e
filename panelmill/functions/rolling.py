"""Rolling statistics that Spark has no single function for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .axis import Axis, Wave
from .exprs import col, div, total

DIRECT = 25


def rolling_corr(a: Column, b: Column, window, need: int) -> Column:
    """Pearson correlation over complete pairs; NULL with fewer than ``need`` pairs or a constant side.

    Spark's own ``corr`` raises on zero variance, so it is built from its parts.
    """
    ok = a.isNotNull() & b.isNotNull()
    x, y = F.when(ok, a), F.when(ok, b)
    flat = (F.min(x).over(window) == F.max(x).over(window)) | (F.min(y).over(window) == F.max(y).over(window))
    r = F.try_divide(F.covar_samp(x, y).over(window), F.stddev_samp(x).over(window) * F.stddev_samp(y).over(window))
    return F.when((F.count(x).over(window) >= need) & ~flat, r)


def quantile_of_sorted(frame: str | Column, n: int, share: float) -> Column:
    """Linear-interpolated quantile of a sorted array of ``n`` values, to the last bit that of Spark's ``percentile``.

    A percentile over a sliding frame counts its values in a map anew for every row; a sorted array takes a third of that.
    """
    at = (n - 1) * share
    low = int(at)
    a, b = F.element_at(frame, low + 1), F.element_at(frame, min(low + 2, n))
    return F.when(a == b, a).otherwise((low + 1 - at) * a + (at - low) * b)


def percent_rank_of_last(frame: Column) -> Column:
    """Average percent rank of the last element of an array within the array."""
    x = F.element_at(frame, -1)
    less = F.size(F.filter(frame, lambda v: v < x))
    same = F.size(F.filter(frame, lambda v: v == x))
    return (less + (same + 1) / 2) / F.size(frame)


def rolling_percent_rank(c: str | Column, axis: Axis, n: int) -> Column:
    return percent_rank_of_last(F.collect_list(col(c)).over(axis.last(n)))


def rolling_apply(c: str | Column, axis: Axis, n: int, fn: Callable, min_rows: int | None = None) -> tuple[Column, Callable[[Column], Column]]:
    """Window array and a vectorised pandas function for user statistics with no native form.

    Usage: ``frame, call = rolling_apply("x", axis, 20, np.ptp)``, then
    ``df.withColumn("f", frame).withColumn("y", call(F.col("f")))``.
    """
    need = n if min_rows is None else min_rows

    @F.pandas_udf("double")
    def call(frames: pd.Series) -> pd.Series:
        return frames.map(lambda v: float(fn(v)) if v is not None and len(v) >= need else None)

    return F.collect_list(col(c)).over(axis.last(n)), call


def _parts(n: int) -> int | None:
    """Largest frame of at most DIRECT rows that divides n, if it saves work."""
    best = max((m for m in range(2, DIRECT + 1) if n % m == 0), default=0)
    return best if best >= 5 and n > DIRECT else None


def _piece(n: int) -> int:
    """Largest frame of a few rows that divides n; n itself if none does."""
    return max((m for m in range(2, (5 if n <= 60 else 10) + 1) if n % m == 0), default=n)


def _steps(n: int) -> list[int]:
    """Frame sizes from a few rows to n, each a small multiple of the one before."""
    primes, rest, p = [], n, 2
    while rest > 1:
        if rest % p == 0:
            primes.append(p)
            rest //= p
        else:
            p += 1
    steps = [max(primes, default=1) if max(primes, default=1) > 7 else _piece(n)]
    rest, p = n // steps[0], 7
    while rest > 1:  # no other prime is above 7, but for frames put together from large primes
        p = max((q for q in range(2, 8) if rest % q == 0), default=rest)
        steps.append(steps[-1] * p)
        rest //= p
    return steps


def rolling_means(x: str | Column, axis: Axis, sizes: dict[int, str], min_rows: str = "any", tag: str = "") -> list[Wave]:
    """Means over the last n rows for several n, as waves.

    Spark re-reads a sliding frame for every row, so a 200-row frame costs 200
    steps a row, each far dearer than a lag.  Frames are put together from
    non-overlapping short ones (200 = 10 + 10 + ... ).
    ``min_rows``: 'any' gives a mean of what is there, 'full' NULL until n
    known values exist.
    """
    x = col(x)
    waves: list[Wave] = [{}, {}, {}]
    bases = {n: _piece(n) for n in sizes}
    s = lambda m: f"_t_rm{tag}_s{m}"
    c = lambda m: f"_t_rm{tag}_c{m}"
    for m in sorted(set(bases.values())):
        waves[0][s(m)] = F.sum(x).over(axis.last(m))
        waves[0][c(m)] = F.count(x).over(axis.last(m))
    for n, m in bases.items():
        if n == m:
            continue
        back = [0] + [k for k in range(m, n, m)]
        at = lambda name, k: F.coalesce(F.col(name) if k == 0 else axis.lag(name, k), F.lit(0))
        waves[1][s(n)] = total([at(s(m), k) for k in back])
        waves[1][c(n)] = total([at(c(m), k) for k in back])
    for n, name in sizes.items():
        mean = div(F.col(s(n)), F.col(c(n)))
        done = mean if min_rows == "any" else F.when(F.col(c(n)) == n, mean)
        waves[1 if bases[n] == n else 2][name] = done
    return waves


def rolling_moments(x: str | Column, axis: Axis, n: int, mean: str, std: str, tag: str = "") -> list[Wave]:
    """Full-window mean and sample deviation over a long frame from short pieces."""
    return chained_moments(x, axis, _steps(n), {n: (mean, std)}, tag)


def chained_moments(x: str | Column, axis: Axis, sizes: Sequence[int], names: dict[int, tuple[str | None, str]], tag: str = "") -> list[Wave]:
    """Full-window mean and sample deviation over frames of growing ``sizes``, each a multiple of the one before, as three waves a size
    after the first; ``names`` says which are wanted, and how they are called.

    Only the first frame slides. The pieces of the others are lags, merged by their counts, means and squared
    deviations, so there is no difference of large sums; equal values have a deviation of exactly 0.
    """
    x, at = col(x), lambda part, n: f"_t_mo{tag}_{part}{n}"
    m, w = sizes[0], axis.last(sizes[0])
    spread = F.when(F.count(x).over(w) > 1, F.var_samp(x).over(w) * (F.count(x).over(w) - 1))
    waves: list[Wave] = [{at("k", m): F.count(x).over(w).cast("double"), at("a", m): F.coalesce(F.avg(x).over(w), F.lit(0.0)), at("q", m): F.coalesce(spread, F.lit(0.0))}]

    def wanted(n: int) -> Wave:
        if n not in names:
            return {}
        whole, (mean, std) = F.col(at("k", n)) == n, names[n]
        out = {std: F.when(whole, F.sqrt(F.col(at("q", n)) / (n - 1)))}
        return out if mean is None else {mean: F.when(whole, F.col(at("a", n))), **out}

    for m, n in zip(sizes, sizes[1:]):
        piece = lambda part, j: F.col(at(part, m) if j == 0 else f"{at(part, m)}_{j}")  # noqa: B023, E731
        back = list(range(m, n, m))
        waves.append({f"{at(part, m)}_{j}": F.coalesce(axis.lag(at(part, m), j), F.lit(0.0)) for part in "kaq" for j in back} | wanted(m))
        k = total([piece("k", j) for j in [0, *back]])
        off = total([piece("k", j) * (piece("a", j) - piece("a", 0)) for j in back])
        waves.append({at("k", n): k, at("a", n): piece("a", 0) + F.coalesce(div(off, k), F.lit(0.0))})
        squares = [piece("q", j) + piece("k", j) * (piece("a", j) - F.col(at("a", n))) * (piece("a", j) - F.col(at("a", n))) for j in [0, *back]]
        waves.append({at("q", n): total(squares)})
    return [*waves, wanted(sizes[-1])]


def rolling_correlation(a: str | Column, b: str | Column, axis: Axis, n: int, name: str, need: int | None = None, tag: str = "") -> list[Wave]:
    """Pearson correlation over the last n rows from short pieces, as waves; NULL with fewer than ``need`` complete pairs (default
    n) or a constant side.

    A piece is kept as the count of its pairs, both means, both sums of squared deviations and of cross products, and
    the ranges. Pieces are merged by Chan's rule, as deviations from the common mean, so that no large sums are subtracted.
    """
    a, b, need = col(a), col(b), n if need is None else need
    pair = a.isNotNull() & b.isNotNull()
    x, y = F.when(pair, a), F.when(pair, b)
    m = _parts(n) or n
    w = axis.last(m)
    piece = F.struct(
        F.count(x).over(w).cast("double").alias("k"), F.avg(x).over(w).alias("mx"), F.avg(y).over(w).alias("my"),
        F.var_pop(x).over(w).alias("vx"), F.var_pop(y).over(w).alias("vy"), F.covar_pop(x, y).over(w).alias("c"),
        F.min(x).over(w).alias("lx"), F.max(x).over(w).alias("hx"), F.min(y).over(w).alias("ly"), F.max(y).over(w).alias("hy"),
    )
    p, got, mean, out = (f"_t_rc{tag}_{k}" for k in ("p", "all", "mean", "sums"))
    first: Wave = {p: piece}
    gather: Wave = {got: F.filter(F.array(F.col(p), *[axis.lag(p, j) for j in range(m, n, m)]), lambda e: e["k"] > 0)}
    fold = lambda e: F.aggregate(got, F.lit(0.0), lambda acc, v: acc + e(v))
    k = fold(lambda v: v["k"])
    means: Wave = {mean: F.struct(k.alias("k"), div(fold(lambda v: v["k"] * v["mx"]), k).alias("x"), div(fold(lambda v: v["k"] * v["my"]), k).alias("y"))}
    mu = F.col(mean)
    sums: Wave = {
        out: F.struct(
            fold(lambda v: v["k"] * (v["vx"] + (v["mx"] - mu["x"]) * (v["mx"] - mu["x"]))).alias("xx"),
            fold(lambda v: v["k"] * (v["vy"] + (v["my"] - mu["y"]) * (v["my"] - mu["y"]))).alias("yy"),
            fold(lambda v: v["k"] * (v["c"] + (v["mx"] - mu["x"]) * (v["my"] - mu["y"]))).alias("xy"),
        )
    }
    low = lambda f: F.array_min(F.transform(got, lambda v: v[f]))
    high = lambda f: F.array_max(F.transform(got, lambda v: v[f]))
    flat = (low("lx") == high("hx")) | (low("ly") == high("hy"))
    s = F.col(out)
    return [first, gather, means, sums, {name: F.when((mu["k"] >= need) & ~flat, F.try_divide(s["xy"], F.sqrt(s["xx"]) * F.sqrt(s["yy"])))}]
