"""Exact quantiles of many columns of groups of any size, without a sort of the rows and without a row per cell.

1. One aggregate makes a mergeable sketch per group and column, and takes from it, for every quantile, a low and a high cut
   that should hold its two neighbouring order statistics between them.
2. A second one counts, for each of these, how many values lie under the low cut and how many between the cuts.
3. Where the counts confirm the cuts, only values between them are looked at: they are folded to (value, copies) and the wanted
   ranks are found in their running counts.  Cells that the counts do not confirm, or whose cuts hold very many values, go
   to ``exact_quantiles``, a distributed sort.

Passes 1 and 2 shuffle one row per group and task, pass 3 about 4 / ACCURACY of the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, written
from .axis import exact_quantiles

ACCURACY = 10_000  # a sketch's ranks are off by up to 1 / ACCURACY of the values
BETWEEN = 2_000_000  # values between two cuts that one task may hold
FEW_GROUPS = 20_000
C = F.col


def _cut_shares(probs: Sequence[float], accuracy: int) -> list[float]:
    return [min(1.0, max(0.0, p + side * 2.0 / accuracy)) for p in probs for side in (-1, 1)]


def column_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: dict[str, float], accuracy: int = ACCURACY, between: int = BETWEEN) -> DataFrame:
    """(keys, column, known, one column per name in ``probs``): linear-interpolated quantiles, one row per group and column.

    Missing values and NaN do not count; a column without values in a group gives NULL.  ``keys`` may be empty.
    """
    if not keys:
        return column_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], columns, probs, accuracy, between).drop("_all")
    names, shares = list(probs), _cut_shares(list(probs.values()), accuracy)
    cells = [(i, j) for i in range(len(columns)) for j in range(len(names))]
    slim = df.select(*keys, *[F.when(~F.isnan(C(c).cast("double")), C(c).cast("double")).alias(f"_x{i}") for i, c in enumerate(columns)])
    aggs = [a for i in range(len(columns)) for a in (F.count(f"_x{i}").alias(f"_n{i}"), F.percentile_approx(f"_x{i}", shares, accuracy).alias(f"_c{i}"))]
    cuts = written(slim.groupBy(*keys).agg(*aggs))
    near = _with(slim, cuts, keys)
    x, low, high = (lambda i: C(f"_x{i}")), (lambda i, j: C(f"_c{i}")[2 * j]), (lambda i, j: C(f"_c{i}")[2 * j + 1])
    counts = [a for i, j in cells for a in (F.count_if(x(i) < low(i, j)).alias(f"_u{i}_{j}"), F.count_if(x(i).between(low(i, j), high(i, j))).alias(f"_b{i}_{j}"))]
    sizes = near.groupBy(*keys).agg(*counts)
    # a few rows per group from here on: one per column and quantile
    long = _with(sizes, cuts, keys).select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), C(f"_n{i}").alias("n"), low(i, j).alias("low"), high(i, j).alias("high"), C(f"_u{i}_{j}").alias("under"), C(f"_b{i}_{j}").alias("inside"))
                    for i, j in cells
                ]
            )
        ),
    )
    share = F.element_at(F.array(*[F.lit(float(p)) for p in probs.values()]), C("j") + 1)
    at = (C("n") - 1) * share
    cell = written(long.withColumns({"at": at, "held": (C("under") <= F.floor(at)) & (C("under") + C("inside") > F.ceil(at)) & (C("inside") <= between)}))
    found = _between(near, cell, keys, cells, low, high)
    lost = cell.filter(~C("held") & (C("n") > 0))
    if not lost.isEmpty():
        found = found.unionByName(_sorted(slim, lost, keys, columns, list(probs.values())))
    wide = found.groupBy(*keys, "i").agg(*[F.max(F.when(C("j") == j, C("q"))).alias(name) for j, name in enumerate(names)])
    head = cell.filter(C("j") == 0).select(*keys, "i", C("n").alias("known"))
    out = _null_safe(head, wide, [*keys, "i"], "left")
    return out.withColumn("column", F.element_at(F.array(*[F.lit(c) for c in columns]), C("i") + 1)).select(*keys, "column", "known", *names)


def _with(rows: DataFrame, per_group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the values of their group; the table is broadcast if a count shows it to be small."""
    return _null_safe(rows, F.broadcast(per_group) if per_group.count() <= FEW_GROUPS else per_group, keys)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    right = right.select(*[C(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same: Column = F.lit(True)
    for i, k in enumerate(keys):
        same = same & C(k).eqNullSafe(C(f"_k{i}"))
    return left.join(right, same, how).drop(*[f"_k{i}" for i in range(len(keys))])


def _between(near: DataFrame, cell: DataFrame, keys: Sequence[str], cells, low, high) -> DataFrame:
    """Quantiles whose cuts are confirmed: (keys, i, j, q)."""
    x = lambda i: C(f"_x{i}")
    picked = F.array_compact(F.array(*[F.when(x(i).between(low(i, j), high(i, j)), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), x(i).alias("v"))) for i, j in cells]))
    some = near.select(*keys, picked.alias("_p")).filter(F.size("_p") > 0).select(*keys, F.inline("_p"))
    folded = some.groupBy(*keys, "i", "j", "v").agg(F.count(F.lit(1)).alias("k"))
    rows = _null_safe(folded, cell.filter("held").select(*keys, "i", "j", "at", "under"), [*keys, "i", "j"]).filter(C("at").isNotNull())
    upto = C("under") + F.sum("k").over(Window.partitionBy(*keys, "i", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto)
    holds = lambda r: (r < C("upto")) & (r >= C("upto") - C("k"))
    return _interpolated(rows.groupBy(*keys, "i", "j").agg(F.max(F.when(holds(F.floor("at")), C("v"))).alias("a"), F.max(F.when(holds(F.ceil("at")), C("v"))).alias("b"), F.max("at").alias("at")), keys)


def _interpolated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(*keys, "i", "j", (C("a") + (C("b") - C("a")) * (C("at") - F.floor("at"))).alias("q"))


def _sorted(slim: DataFrame, lost: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: list[float]) -> DataFrame:
    """Quantiles by distributed sort, for the groups and columns that need it."""
    which = settle(lost.select(*keys, "i").distinct())
    parts = None
    for i in sorted(r["i"] for r in which.select("i").distinct().collect()):  # one per column at most
        mine = which.filter(C("i") == i).drop("i")
        rows = slim.select(*keys, C(f"_x{i}").alias("v"))
        rows = _null_safe(rows, mine, keys)
        q = exact_quantiles(rows, keys, "v", {f"q{j}": p for j, p in enumerate(probs)})
        q = q.select(*keys, F.lit(i).alias("i"), F.inline(F.array(*[F.struct(F.lit(j).alias("j"), C(f"q{j}").alias("q")) for j in range(len(probs))])))
        parts = q if parts is None else parts.unionByName(q)
    return _null_safe(parts, lost.select(*keys, "i", "j", F.lit(1).alias("_lost")), [*keys, "i", "j"]).filter("_lost = 1").drop("_lost")
