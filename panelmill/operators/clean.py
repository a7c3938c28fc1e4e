"""Filling, de-duplication, cleaning and per-row derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axis import DAILY, Axis, Scan, apply_waves, per_key, position, running
from ..functions.exprs import div, finite, flag, full, numeric_columns, total

C = F.col


# ------------------------------------------------------------ fills


def forward_fill(df: DataFrame, cols: Sequence[str], axis: Axis = DAILY, limit: int | None = None) -> DataFrame:
    """Carry the last known value forward, over at most ``limit`` rows."""
    if limit is None:
        return running(df, axis, {c: Scan("last", C(c)) for c in cols})
    return df.withColumns({c: F.last(c, ignorenulls=True).over(axis.last(limit + 1)) for c in cols})


def back_fill(df: DataFrame, cols: Sequence[str], axis: Axis = DAILY) -> DataFrame:
    """Carry the next known value backward (this looks ahead in time)."""
    return running(df, axis, {c: Scan("next", C(c)) for c in cols})


def fill_both(df: DataFrame, cols: Sequence[str], axis: Axis = DAILY) -> DataFrame:
    """Forward, then backward: what is missing after the first is before the first known value, and takes that.

    On the plain layout this is a value of the series in the order at hand, so that rows are not sorted again from the end.
    """
    if axis.block is not None:
        return back_fill(forward_fill(df, cols, axis), cols, axis)
    series = axis.by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = {f"_t_first_{i}": F.first(c, ignorenulls=True).over(series) for i, c in enumerate(cols)}
    df = forward_fill(df.withColumns(first), cols, axis)
    return df.withColumns({c: F.coalesce(C(c), C(f"_t_first_{i}")) for i, c in enumerate(cols)}).drop(*first)


def interpolate(df: DataFrame, cols: Sequence[str], axis: Axis = DAILY, limit: int | None = None) -> DataFrame:
    """Straight line between known neighbours by row position; the tail repeats the last value.

    At most ``limit`` rows after a known value are filled; leading gaps stay.
    """
    df = df.withColumn("_t_pos", position(axis).cast("double"))
    scans: dict[str, Scan] = {}
    for c in cols:
        at = F.when(C(c).isNotNull(), C("_t_pos"))
        scans |= {f"_t_{c}_p": Scan("last", C(c).cast("double")), f"_t_{c}_q": Scan("last", at)}
        scans |= {f"_t_{c}_n": Scan("next", C(c).cast("double")), f"_t_{c}_m": Scan("next", at)}
    df = running(df, axis, scans)
    out = {}
    for c in cols:
        p, q, n, m = (C(f"_t_{c}_{s}") for s in "pqnm")
        away = C("_t_pos") - q
        line = p + F.coalesce((n - p) * div(away, m - q), F.lit(0.0))
        near = F.lit(True) if limit is None else away <= limit
        out[c] = F.coalesce(C(c).cast("double"), F.when(near, line))
    df = df.withColumns(out)
    return df.drop("_t_pos", *[f"_t_{c}_{s}" for c in cols for s in "pqnm"])


def gap_columns(df: DataFrame, cols: Sequence[str], axis: Axis = DAILY) -> list[str]:
    """Those of ``cols`` that are missing in some row after a known value of their series; filling leaves all others as they are.

    One aggregate: a column has such a row where it is missing more often than before its first known value. Reads ``df``
    once, so it should be a written table.
    """
    if not cols:
        return []
    rows = df.select(*axis.key, position(axis).alias("_t_pos"), *cols)
    known = lambda c: F.min(F.when(C(c).isNotNull(), C("_t_pos") - 1))
    per = rows.groupBy(*axis.key).agg(*[(F.count_if(C(c).isNull()) > F.coalesce(known(c), F.count(F.lit(1)))).alias(f"_g{i}") for i, c in enumerate(cols)])
    found = per.agg(*[F.max(f"_g{i}").alias(f"_g{i}") for i in range(len(cols))]).first()
    return [c for i, c in enumerate(cols) if found[f"_g{i}"]]


def column_gaps(df: DataFrame, cols: Sequence[str], axis: Axis = DAILY, max_missing: float = 0.5, keep: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(``gap_columns`` of ``cols``, columns missing in more than ``max_missing`` of all rows) from one aggregate.

    The second list is right as it stands only where the first is empty, as filling adds values.
    """
    others = [c for c in df.columns if c not in keep]
    rows = df.withColumn("_t_pos", position(axis))
    known = lambda c: F.min(F.when(C(c).isNotNull(), C("_t_pos") - 1))
    missing = [F.count_if(C(c).isNull()).alias(f"_n{i}") for i, c in enumerate(others)]
    per = rows.groupBy(*axis.key).agg(F.count(F.lit(1)).alias("_rows"), *missing, *[known(c).alias(f"_k{i}") for i, c in enumerate(cols)])
    at = {c: i for i, c in enumerate(others)}
    holes = [F.max(C(f"_n{at[c]}") > F.coalesce(C(f"_k{i}"), C("_rows"))).alias(f"_g{i}") for i, c in enumerate(cols)]
    found = per.agg(F.sum("_rows").alias("_rows"), *holes, *[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(others))]).first()
    empty = [c for i, c in enumerate(others) if found["_rows"] and found[f"_n{i}"] / found["_rows"] > max_missing]
    return [c for i, c in enumerate(cols) if found[f"_g{i}"]], empty


def mean_fill(df: DataFrame, cols: Sequence[str], axis: Axis = DAILY) -> DataFrame:
    df = per_key(df, axis, {f"_t_{c}_mean": F.avg(c) for c in cols})
    return df.withColumns({c: F.coalesce(C(c), C(f"_t_{c}_mean")) for c in cols}).drop(*[f"_t_{c}_mean" for c in cols])


def handle_missing(df: DataFrame, method: str = "interpolate", axis: Axis = DAILY) -> DataFrame:
    """'drop', 'interpolate' (limit 5), 'forward_fill' (limit 5) or 'mean'."""
    values = [c for c in df.columns if c not in (*axis.parts, *axis.order) and not c.startswith("__")]
    numeric = [c for c in numeric_columns(df) if c in values]
    if method == "drop":
        return df.na.drop()
    if method == "interpolate":
        # whole-number columns (flags, calendar fields) hold no gaps and keep their type
        return interpolate(df, [c for c in numeric if dict(df.dtypes)[c] in ("double", "float")], axis, limit=5)
    if method == "forward_fill":
        return forward_fill(df, values, axis, limit=5)
    if method == "mean":
        return mean_fill(df, numeric, axis)
    raise ValueError(f"unknown method: {method}")


# ------------------------------------------------------------ rows and columns


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """One row per key, the first in ``order``; ties are settled by the whole row.

    An aggregate rather than a ranked window: copies are folded on the map
    side, so a key with any number of copies never meets in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    rank = F.struct(*[(C(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate([*order, *rest])])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r"))
    return picked.select(*[C(c) if c in keys else C("_r")[c].alias(c) for c in df.columns])


def drop_duplicate_times(df: DataFrame, axis: Axis = DAILY, order: Sequence[str] = ()) -> DataFrame:
    return keep_first(df, [*axis.key, axis.ts], order)


def drop_infinite(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating column."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: finite(c) for c in floats})


def drop_sparse_columns(df: DataFrame, max_missing: float = 0.5, keep: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Drop columns missing in more than ``max_missing`` of all rows (runs one aggregate)."""
    cols = [c for c in df.columns if c not in keep]
    if not cols:
        return df
    share = df.agg(*[F.avg(C(c).isNull().cast("double")).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if share[c] is not None and share[c] > max_missing])


def clean_market_data(df: DataFrame, axis: Axis = DAILY, order: Sequence[str] = (), backfill: bool = True) -> DataFrame:
    """Coerce time, drop duplicate times, drop empty rows, fill forward and (optionally) backward."""
    if dict(df.dtypes)[axis.ts] == "string":
        df = df.withColumn(axis.ts, F.try_to_timestamp(C(axis.ts)))
    df = drop_duplicate_times(df.filter(C(axis.ts).isNotNull()), axis, order)
    values = [c for c in df.columns if c not in (*axis.parts, *axis.order) and c not in order]
    df = df.na.drop("all", subset=values)
    return fill_both(df, values, axis) if backfill else forward_fill(df, values, axis)


def final_cleanup(df: DataFrame, axis: Axis = DAILY, order: Sequence[str] = ()) -> DataFrame:
    """Duplicate times, infinities and mostly-empty columns out."""
    return drop_sparse_columns(drop_infinite(drop_duplicate_times(df, axis, order)), keep=(*axis.key, axis.ts))


def add_missing_counts(df: DataFrame) -> DataFrame:
    """``missing_count`` per row, and its share of the columns including itself."""
    n = len(df.columns) + 1
    df = df.withColumn("missing_count", total([C(c).isNull().cast("int") for c in df.columns]))
    return df.withColumn("missing_pct", C("missing_count") / n)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) from one pass."""
    counts = df.agg(*[F.count_if(C(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), C(c).alias("nulls")) for c in df.columns])
    return counts.select(F.inline(pairs))


# ------------------------------------------------------------ calendar columns


def temporal_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    day = C(ts).cast("date")
    quarter = F.trunc(day, "quarter")
    return df.withColumns(
        {
            "day_of_week": F.weekday(day),
            "day_of_month": F.dayofmonth(day),
            "week_of_year": F.weekofyear(day),
            "month": F.month(day),
            "quarter": F.quarter(day),
            "year": F.year(day),
            "is_monday": flag(F.weekday(day) == 0),
            "is_friday": flag(F.weekday(day) == 4),
            "is_month_start": flag(F.dayofmonth(day) == 1),
            "is_month_end": flag(day == F.last_day(day)),
            "is_quarter_start": flag(day == quarter),
            "is_quarter_end": flag(day == F.last_day(F.add_months(quarter, 2))),
        }
    )


def model_time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    day = C(ts).cast("date")
    return df.withColumns(
        {
            "day_of_week": F.weekday(day),
            "day_of_month": F.dayofmonth(day),
            "month": F.month(day),
            "quarter": F.quarter(day),
            "is_monday": flag(F.weekday(day) == 0),
            "is_friday": flag(F.weekday(day) == 4),
        }
    )


def weekday_effects(df: DataFrame, ts: str = "ts") -> DataFrame:
    wd = F.weekday(C(ts).cast("date"))
    return df.withColumns({"day_of_week": wd, "is_weekend": flag(wd >= 5), "is_monday": flag(wd == 0), "is_friday": flag(wd == 4)})


# ------------------------------------------------------------ lags, splits, transforms


def lag_columns(df: DataFrame, cols: Sequence[str], lags: Sequence[int] = (1, 2, 3, 5, 10), axis: Axis = DAILY) -> DataFrame:
    return df.withColumns({f"{c}_lag_{k}": axis.lag(c, k) for c in cols for k in lags})


def model_lag_features(
    df: DataFrame,
    axis: Axis = DAILY,
    cols: Sequence[str] = ("open", "high", "low", "close", "volume"),
    price: str = "close",
    lags: Sequence[int] = (1, 2, 3, 5, 10, 20),
    windows: Sequence[int] = (5, 10, 20),
) -> DataFrame:
    """Lagged values, lagged one-step returns of the price columns, full-window statistics of the price."""
    prices = [c for c in cols if c != "volume"]
    w0 = {f"{c}_lag_{k}": axis.lag(c, k) for c in cols for k in lags}
    w0 |= {f"_t_{c}_ret": axis.pct(c) for c in prices}
    for n in windows:
        w = axis.last(n)
        for stat, fn in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min)):
            w0[f"{price}_rolling_{stat}_{n}"] = full(n, price, w, fn(C(price)).over(w))
    w1 = {f"{c}_return_lag_{k}": axis.lag(f"_t_{c}_ret", k) for c in prices for k in lags}
    return apply_waves(df, axis, [w0, w1])


def log_transform(df: DataFrame, value: str, axis: Axis = DAILY, out: str = "log_value") -> DataFrame:
    """ln of the value, shifted up by |min| + 1e-8 when a series holds a non-positive value."""
    df = per_key(df, axis, {"_t_min": F.min(value)})
    shift = F.when(C("_t_min") <= 0, F.abs("_t_min") + 1e-8).otherwise(F.lit(0.0))
    return df.withColumns({"log_shift": shift, out: F.ln(C(value) + shift)}).drop("_t_min")


def inverse_log(df: DataFrame, value: str, out: str, shift: str = "log_shift") -> DataFrame:
    return df.withColumn(out, F.exp(value) - C(shift))


def chronological_split(df: DataFrame, fraction: float = 0.8, axis: Axis = DAILY, out: str = "split") -> DataFrame:
    """Mark the first floor(n*fraction) rows of every series 'train', the rest 'test'."""
    df = per_key(df, axis, {"_t_rows": F.count(F.lit(1))}).withColumn("_t_pos", position(axis))
    return df.withColumn(out, F.when(C("_t_pos") <= F.floor(C("_t_rows") * fraction), "train").otherwise("test")).drop("_t_rows", "_t_pos")


def article_text(df: DataFrame, cols: Sequence[str] = ("title", "description"), out: str = "text", skip_missing: bool = True) -> DataFrame:
    """Join the given columns with a blank; missing parts are skipped, or kept as empty strings."""
    parts = [C(c) if skip_missing else F.coalesce(C(c), F.lit("")) for c in cols]
    return df.withColumn(out, F.concat_ws(" ", *parts))


def pad_context(df: DataFrame, array: str, length: int, out: str | None = None) -> DataFrame:
    """Exactly ``length`` newest values, left-padded with the first one."""
    a = C(array)
    padded = F.concat(F.array_repeat(F.element_at(a, 1), F.greatest(F.lit(length) - F.size(a), F.lit(0))), a)
    return df.withColumn(out or array, F.slice(padded, -length, length))
