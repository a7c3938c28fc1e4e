"""Joining series: as-of, alignment to market rows, outer concatenation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axis import DAILY, Axis, Scan, in_blocks, running
from ..session import written
from .clean import back_fill, forward_fill, interpolate

C = F.col
SMALL_ROWS = 200_000
SLOW_SHARE = 0.5  # a macro series with fewer rows than this share of the market's times is matched as of the day


def small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast ``df`` if a count shows that it is small; otherwise leave the join to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


# ------------------------------------------------------------ as-of


def asof_join(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    axis: Axis = DAILY,
    skip_missing: bool = False,
    observed: str | None = None,
    blocked: bool = False,
    rows_per_block: int = 200_000,
) -> DataFrame:
    """For every left row the latest right row with the same key and ts <= left ts.

    Both sides are stacked and the last right row is carried forward, so the
    cost is one sort of the union, not a search per row.  ``skip_missing``
    carries each column's last non-missing value instead of the last row.
    ``observed`` names an extra column for the matched right time.  With
    ``blocked`` a key of any size is cut into blocks.
    """
    keep = left.columns
    l_side = left.select(*keep, *[F.lit(None).cast(right.schema[v].dataType).alias(f"_r_{v}") for v in values], F.lit(1).alias("_side"))
    r_side = right.select(
        *[C(c) if c in (*axis.key, axis.ts) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in keep],
        *[C(v).alias(f"_r_{v}") for v in values],
        F.lit(0).alias("_side"),
    )
    both = l_side.unionByName(r_side)
    stacked_axis = Axis(axis.key, axis.ts, ("_side", *[t for t in axis.tie if t in keep]))

    def carry(df: DataFrame, ax: Axis) -> DataFrame:
        is_right = C("_side") == 0
        row = F.struct(C(ax.ts).alias("t"), *[C(f"_r_{v}").alias(v) for v in values])
        scans = {"_m": Scan("last", F.when(is_right, row))}
        if skip_missing:
            scans |= {f"_v_{v}": Scan("last", C(f"_r_{v}")) for v in values}
        df = running(df, ax, scans)
        picks = {v: C(f"_v_{v}") if skip_missing else C("_m")[v] for v in values}
        if observed:
            picks[observed] = C("_m")["t"]
        return df.filter(C("_side") == 1).withColumns(picks).drop("_m", "_side", *[f"_r_{v}" for v in values], *[f"_v_{v}" for v in values])

    if blocked:
        return in_blocks(both, stacked_axis, carry, before=0, rows_per_block=rows_per_block)
    return carry(both, stacked_axis)


def daily_lookup(series: DataFrame, until: Column | str | None = None, date: str = "date", series_id: str = "series_id", value: str = "value") -> DataFrame:
    """Spread slow observations over every calendar day until the next one.

    Rows are bounded by days x series, whatever the size of the market side.
    """
    w = Window.partitionBy(series_id).orderBy(date)
    nxt = F.lead(C(date)).over(w)
    last = F.date_sub(nxt, 1)
    end = F.coalesce(last, C("_until"), C(date))
    s = series.select(C(series_id).alias("series_id"), C(date).cast("date").alias(date), C(value).alias("value"))
    s = s.withColumn("_until", F.to_date(F.lit(until)) if isinstance(until, str) else (until if until is not None else F.lit(None).cast("date")))
    s = s.withColumn("_end", F.greatest(end, C(date)))
    return s.select("series_id", C(date).alias("observed"), "value", F.explode(F.sequence(C(date), C("_end"))).alias("day"))


def is_low_frequency(market: DataFrame, series: DataFrame, axis: Axis = DAILY, share: float = SLOW_SHARE) -> bool:
    """A series counts as slow if it has fewer rows than this share of the market's distinct times (two counts)."""
    return series.count() < share * market.select(axis.ts).distinct().count()


def align_macro(
    market: DataFrame,
    macro: DataFrame,
    series: Sequence[str],
    axis: Axis = DAILY,
    how: str = "left",
    slow: bool | None = None,
    fill: str | None = None,
    prefix: str = "",
) -> DataFrame:
    """Attach long-form macro series to market rows as one column each.

    Slow series are matched as of the day, with ``<name>_days_since_update``;
    fast ones on equal dates.  ``slow`` says so for all series; without it each
    is judged by its rows (fewer than half of the market's distinct times: slow).
    The lookup table holds at most one row per
    calendar day, so it is broadcast (after a size check) and the market side
    is not shuffled for inner and left joins.
    """
    wanted = macro.filter(C("series_id").isin(*series))
    last_day, lagging = None, set(series) if slow else set()
    if slow is not False:
        sizes = [F.max(C(axis.ts).cast("date")).alias("last")] + ([F.count_distinct(axis.ts).alias("times")] if slow is None else [])
        seen = market.agg(*sizes).first()
        last_day = seen["last"]
        if slow is None:
            rows = dict(wanted.groupBy("series_id").count().collect())  # one row per series named
            lagging = {s for s in series if rows.get(s, 0) < SLOW_SHARE * seen["times"]}
    sent = C("series_id").isin(*lagging) if lagging else F.lit(False)
    looked = wanted.filter(~sent).select("series_id", C("date").cast("date").alias("observed"), "value", C("date").cast("date").alias("day"))
    if lagging:
        looked = looked.unionByName(daily_lookup(wanted.filter(sent), until=None if last_day is None else F.lit(last_day)))
    names = {s: f"{prefix}{s}" for s in series}
    aggs = []
    for s in series:
        hit = F.when(C("series_id") == s, C("value"))
        aggs.append(F.max(hit).alias(names[s]))
        if s in lagging:
            aggs.append(F.max(F.when(C("series_id") == s, C("observed"))).alias(f"_obs_{s}"))
    wide = looked.groupBy("day").agg(*aggs)
    left = market.withColumn("day", C(axis.ts).cast("date"))
    out = left.join(small(wide) if how in ("left", "inner") else wide, "day", how)
    if how in ("right", "outer", "full"):
        out = out.withColumn(axis.ts, F.coalesce(C(axis.ts), C("day").cast(market.schema[axis.ts].dataType)))
    out = out.withColumns({f"{names[s]}_days_since_update": F.datediff("day", f"_obs_{s}") for s in series if s in lagging})
    out = out.drop("day", *[f"_obs_{s}" for s in lagging])
    cols = [c for c in out.columns if c not in (*axis.key, *axis.order)]
    numeric = [c for c, t in out.dtypes if c in cols and t in ("double", "float", "int", "bigint")]
    if fill == "ffill":
        return forward_fill(out, cols, axis)
    if fill == "bfill":
        return back_fill(out, cols, axis)
    if fill == "interpolate":
        return interpolate(out, numeric, axis)
    return out


# ------------------------------------------------------------ equi joins


def join_with_suffix(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", suffix: str = "_right") -> DataFrame:
    """Join; right columns that clash with left ones get a suffix."""
    clash = {c.lower() for c in left.columns} - {k.lower() for k in on}
    renamed = right.select(*[C(c).alias(c + suffix) if c.lower() in clash else C(c) for c in right.columns])
    return left.join(renamed, list(on), how)


def combine_first(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join; the left value wins where both exist."""
    r = right.select(*on, *[C(c).alias(f"_r_{c}") for c in right.columns if c not in on])
    both = left.join(r, list(on), "full")
    names = [c for c in left.columns if c not in on] + [c for c in right.columns if c not in on and c not in left.columns]
    pick = lambda c: F.coalesce(*[C(x) for x in (c, f"_r_{c}") if x in both.columns])
    return both.select(*on, *[pick(c).alias(c) for c in names])


def outer_concat(frames: Sequence[DataFrame], on: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Outer join of many frames on equal keys in one shuffle: stack, then keep the one value per column.

    Each frame must hold at most one row per key.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.groupBy(*on).agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns if c not in on])


def align_frames(frames: Sequence[DataFrame], on: Sequence[str] = ("symbol", "ts"), how: str = "outer") -> DataFrame:
    """Fold frames with one join type."""
    if how in ("outer", "full"):
        return outer_concat(frames, on)
    return reduce(lambda a, b: a.join(b, list(on), how), frames)


def overlap(truth: DataFrame, predicted: DataFrame, on: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    return truth.join(predicted, list(on), "inner")


def join_llm_daily(daily: DataFrame, llm: DataFrame, on: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Attach model-scored daily sentiment with suffix ``_llm``; missing becomes 0."""
    extra = [c for c in llm.columns if c not in on]
    renamed = llm.select(*on, *[C(c).alias(f"{c}_llm") for c in extra])
    return daily.join(renamed, list(on), "left").na.fill(0, subset=[f"{c}_llm" for c in extra])


def market_neutral(df: DataFrame, value: str, axis: Axis = DAILY, out: str = "neutral", single_asset: bool = False) -> DataFrame:
    """Value minus the mean of all symbols at the same time (or of the series, for one asset)."""
    on = list(axis.key) if single_asset else [axis.ts]
    mean = written(df.groupBy(*on).agg(F.avg(value).alias("_mean")))  # counted from the written table, not by running ``df`` again
    return df.join(small(mean), on, "left").withColumn(out, C(value) - C("_mean")).drop("_mean")
