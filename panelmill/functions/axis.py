"""Ordered series inside a long panel table, and how they are laid out on the cluster.

A panel is a long table: one row per (key, ts).  Rolling features need the
rows of one key in time order.  There are two layouts:

* plain: ``Window.partitionBy(key).orderBy(ts)``.  Right when a key's series
  is bounded by the calendar (daily bars: at most ~36,500 rows a century, no
  matter how many raw trades were folded into them).
* blocked: a key may hold any share of all rows (ticks, events).  Rows are
  range-partitioned by (key, ts, tie), numbered, and cut into blocks of equal
  row count; every block carries a copy of the ``before`` rows ahead of it and
  the ``after`` rows behind it, so each finite window is exact inside its
  block.  Unbounded scans (running sums, carried values) combine an in-block
  scan with a carry taken from a small per-block summary table.

Operators are written once against ``Axis`` and ``Scan`` and run on both.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .exprs import col

ROWS_PER_BLOCK = 200_000


@dataclass(frozen=True)
class Axis:
    key: tuple[str, ...] = ("symbol",)
    ts: str = "ts"
    tie: tuple[str, ...] = ()
    block: str | None = None

    @property
    def parts(self) -> tuple[str, ...]:
        return self.key + ((self.block,) if self.block else ())

    @property
    def order(self) -> tuple[str, ...]:
        return (self.ts, *self.tie)

    def by_time(self):
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def last(self, n: int):
        """The current row and the n-1 rows ahead of it."""
        return self.by_time().rowsBetween(-(n - 1), 0)

    def upto(self):
        return self.by_time().rowsBetween(Window.unboundedPreceding, 0)

    def onward(self):
        """The current row and everything after it, read from the end.

        A frame that reaches to the unbounded end is re-scanned for every row;
        the reversed order gives the same rows as a running frame, one step each.
        """
        back = [F.desc(c) for c in self.order]
        return Window.partitionBy(*self.parts).orderBy(*back).rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, c, k: int = 1) -> Column:
        return F.lag(col(c), k).over(self.by_time())

    def lead(self, c, k: int = 1) -> Column:
        return F.lead(col(c), k).over(self.by_time())

    def diff(self, c, k: int = 1) -> Column:
        return col(c) - self.lag(c, k)

    def pct(self, c, k: int = 1) -> Column:
        """Relative change against k rows ago (dense input; fill gaps first)."""
        return F.try_divide(col(c), self.lag(c, k)) - 1


DAILY = Axis()


@dataclass(frozen=True)
class Scan:
    """An unbounded running value: sum, count, product, max, min, last (carry forward), next (carry back)."""

    kind: str
    value: Column


_AGG = {"sum": F.sum, "count": F.count, "product": F.product, "max": F.max, "min": F.min}


def _local(scan: Scan, axis: Axis) -> Column:
    if scan.kind == "last":
        return F.last(scan.value, ignorenulls=True).over(axis.upto())
    if scan.kind == "next":
        return F.last(scan.value, ignorenulls=True).over(axis.onward())
    return _AGG[scan.kind](scan.value).over(axis.upto())


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("last", "next"):
        return F.coalesce(local, carry)
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    both = carry * local if kind == "product" else carry + local
    return F.coalesce(both, local, carry)


def running(df: DataFrame, axis: Axis, scans: dict[str, Scan]) -> DataFrame:
    """Add unbounded running values, exact on either layout."""
    if not scans:
        return df
    if axis.block is None:
        return df.withColumns({n: _local(s, axis) for n, s in scans.items()})

    # The values scanned may themselves hold window functions: fix them first.
    # Warm-up copies saw too little history to carry a right value: leave them out.
    df = df.withColumns({f"__v_{n}": s.value for n, s in scans.items()})
    df = df.withColumns({f"__v_{n}": F.when(F.col("__halo") < 2, F.col(f"__v_{n}")) for n in scans})
    own, body = F.col("__halo") == 0, F.col("__tail") == 0
    order = F.struct(*axis.order)
    aggs: list[Column] = []
    for n, s in scans.items():
        v = F.col(f"__v_{n}")
        if s.kind == "last":
            aggs.append(F.max_by(v, F.when(v.isNotNull(), order)).alias(f"__f_{n}"))
            aggs.append(F.max_by(v, F.when(v.isNotNull() & body, order)).alias(f"__d_{n}"))
        elif s.kind == "next":
            aggs.append(F.min_by(v, F.when(v.isNotNull(), order)).alias(f"__f_{n}"))
        else:
            aggs.append(_AGG[s.kind](v).alias(f"__f_{n}"))
            aggs.append(_AGG[s.kind](F.when(body, v)).alias(f"__d_{n}"))
    blocks = df.filter(own).groupBy(*axis.parts).agg(*aggs)
    w = Window.partitionBy(*axis.key).orderBy(axis.block)
    older = w.rowsBetween(Window.unboundedPreceding, -2)
    newer = Window.partitionBy(*axis.key).orderBy(F.desc(axis.block)).rowsBetween(Window.unboundedPreceding, -1)
    carry: list[Column] = []
    for n, s in scans.items():
        f, d = F.col(f"__f_{n}"), F.lag(f"__d_{n}", 1).over(w)
        if s.kind == "next":
            c = F.last(f, ignorenulls=True).over(newer)
        elif s.kind == "last":
            c = F.coalesce(d, F.last(f, ignorenulls=True).over(older))
        else:
            fold = F.sum if s.kind == "count" else _AGG[s.kind]
            c = _combine("sum" if s.kind == "count" else s.kind, fold(f).over(older), d)
        carry.append(c.alias(f"__c_{n}"))
    carries = blocks.select(*axis.parts, *carry)
    local = df.withColumns({f"__l_{n}": _local(Scan(s.kind, F.col(f"__v_{n}")), axis) for n, s in scans.items()})
    out = local.join(carries, list(axis.parts), "left")
    out = out.withColumns({n: _combine("sum" if s.kind == "count" else s.kind, F.col(f"__c_{n}"), F.col(f"__l_{n}")) for n, s in scans.items()})
    return out.drop(*[f"__{p}_{n}" for n in scans for p in "vcl"])


def per_key(df: DataFrame, axis: Axis, aggs: dict[str, Column]) -> DataFrame:
    """Attach whole-series aggregates to every row of the series."""
    if axis.block is None:
        whole = Window.partitionBy(*axis.key)
        return df.withColumns({n: a.over(whole) for n, a in aggs.items()})
    # pre-aggregate per key, then spread over the blocks: no key meets in one task
    totals = df.filter(F.col("__halo") == 0).groupBy(*axis.key).agg(*[a.alias(n) for n, a in aggs.items()])
    parts = df.select(*axis.parts).distinct()
    return df.join(parts.join(totals, list(axis.key)), list(axis.parts), "left")


def position(axis: Axis) -> Column:
    """1-based row number of a row within its series."""
    return F.row_number().over(axis.by_time()) if axis.block is None else F.col("__rn") + 1


# --------------------------------------------------------------- waves

Wave = dict[str, "Column | Scan"]


def delayed(waves: Sequence[Wave], by: int) -> list[Wave]:
    """The same waves, started ``by`` waves later."""
    return [{} for _ in range(by)] + list(waves)


def stacked(*families: Sequence[Wave]) -> list[Wave]:
    """Overlay families of waves so that equal stages share one projection."""
    out: list[Wave] = [{} for _ in range(max(len(f) for f in families))]
    for fam in families:
        for i, wave in enumerate(fam):
            out[i].update(wave)
    return out


def apply_waves(df: DataFrame, axis: Axis, *families: Sequence[Wave], keep_temp: bool = False) -> DataFrame:
    """Run staged features: wave i may use every column of waves < i.

    All families share (partition, order), so Spark plans one Exchange, one
    Sort and one Window per wave, however many features there are.  Columns
    whose name starts with ``_t_`` are scratch and are dropped at the end.
    """
    for wave in stacked(*families):
        plain = {n: c for n, c in wave.items() if not isinstance(c, Scan)}
        scans = {n: c for n, c in wave.items() if isinstance(c, Scan)}
        if axis.block is None:
            plain = {n: _local(c, axis) if isinstance(c, Scan) else c for n, c in wave.items()}
            scans = {}
        if plain:
            df = df.withColumns(plain)
        if scans:
            df = running(df, axis, scans)
    return df if keep_temp else df.drop(*[c for c in df.columns if c.startswith("_t_")])


# --------------------------------------------------------------- blocked layout


def number_rows(df: DataFrame, axis: Axis, name: str = "__rn", partitions: int | None = None, count: str | None = None) -> DataFrame:
    """0-based row number per key in (ts, tie) order without bringing a key into one task.

    Range partitioning cuts a heavy key into many tasks; each task numbers its
    own rows; a table of (key, task) counts, no larger than tasks + keys,
    supplies the offsets.  The numbered rows are checkpointed because both the
    counts and the final rows must see the very same cut.  ``count`` names an
    extra column for the rows of the key.  A NULL in a key column raises an
    error: the counts are joined by equality, which would lose such rows.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    order = [*axis.key, *axis.order]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = {k: F.coalesce(F.col(k), F.raise_error(F.lit(f"NULL in key column {k}"))) for k in axis.key}
    laid = (
        df.withColumns(named)
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("__id", F.monotonically_increasing_id())
        .withColumn("__task", F.shiftright("__id", 33))
        .checkpoint()
    )
    runs = laid.groupBy(*axis.key, "__task").agg(F.min("__id").alias("__lo"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*axis.key).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("__n").over(Window.partitionBy(*axis.key)).alias(count)] if count else []
    offsets = runs.select(*axis.key, "__task", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__lo")).alias("__off"), *whole)
    return (
        laid.join(offsets, [*axis.key, "__task"])
        .withColumn(name, F.col("__id") + F.col("__off"))
        .drop("__id", "__task", "__off")
    )


def in_blocks(
    df: DataFrame,
    axis: Axis,
    fn: Callable[[DataFrame, Axis], DataFrame],
    before: int,
    after: int = 0,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Run ``fn(df, axis)`` on the blocked layout; results equal the plain layout.

    ``before``/``after`` are the rows the longest finite window looks back and
    ahead.  Where windows read a running value, the older half of the copied
    rows only warms up the inputs of that value, so ``before`` must be twice
    the longest look-back.  ``__rn``, ``__halo``, ``__tail`` must pass through
    ``fn``.
    """
    if before > rows_per_block or after > rows_per_block:
        raise ValueError("a window may not be longer than a block")
    rn, size = F.col("__rn"), F.lit(rows_per_block)
    tail = rows_per_block - before // 2
    home, pos = F.floor(rn / size), rn % size
    copies = [F.struct(home.alias("blk"), F.lit(0).alias("halo"))]
    extra = []
    if before:
        extra.append(F.when(pos >= rows_per_block - before, F.struct((home + 1).alias("blk"), F.when(pos >= tail, 1).otherwise(2).alias("halo"))))
    if after:
        extra.append(F.when((pos < after) & (home > 0), F.struct((home - 1).alias("blk"), F.lit(1).alias("halo"))))
    homes = F.array_compact(F.array(*copies, *extra)) if extra else F.array(*copies)
    cut = (
        number_rows(df, axis)
        .withColumn("__tail", (pos >= tail).cast("int"))
        .withColumn("__copy", F.explode(homes))
        .withColumn("__block", F.col("__copy.blk"))
        .withColumn("__halo", F.col("__copy.halo"))
        .drop("__copy")
    )
    out = fn(cut, replace(axis, block="__block"))
    return out.filter(F.col("__halo") == 0).drop("__rn", "__halo", "__tail", "__block")


def by_size(
    df: DataFrame,
    axis: Axis,
    fn: Callable[[DataFrame, Axis], DataFrame],
    before: int,
    after: int = 0,
    longest: int = 2_000_000,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Pick the layout from the data: blocked if any key holds more than ``longest`` rows (one aggregate)."""
    top = df.groupBy(*axis.key).count().agg(F.max("count")).first()[0] or 0
    if top <= longest:
        return fn(df, axis)
    return in_blocks(df, axis, fn, before, after, rows_per_block)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key by distributed sort: one row per key.

    For groups too large for ``percentile``, whose state holds every distinct
    value of a group.  Copies of a value are folded to one row with a count
    before the range shuffle, so a value held by most rows meets in no task.
    Only the two neighbours of each quantile are kept.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folded = df.select(*keys, value).filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    laid = folded.repartitionByRange(n, *keys, value).withColumn("__task", F.spark_partition_id()).checkpoint()
    near = Window.partitionBy(*keys, "__task").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy(*keys, "__task").agg(F.sum("__n").alias("__m"))  # one row per key and task at most
    offsets = offsets.withColumns({"__off": F.coalesce(F.sum("__m").over(earlier), F.lit(0)), "__cnt": F.sum("__m").over(Window.partitionBy(*keys))})
    renamed = offsets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__task").alias("__t"), "__off", "__cnt")
    same = F.col("__task") == F.col("__t")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = laid.withColumn("__upto", F.sum("__n").over(near)).join(renamed, same)
    last = F.col("__off") + F.col("__upto") - 1  # 0-based positions of the copies of a value
    aggs = []
    for name, p in probs.items():
        at = (F.col("__cnt") - 1) * F.lit(float(p))
        holds = lambda x: (x <= last) & (x > last - F.col("__n"))
        below = F.max(F.when(holds(F.floor(at)), F.col(value)))
        above = F.max(F.when(holds(F.ceil(at)), F.col(value)))
        aggs.append((below + (above - below) * F.max(at - F.floor(at))).alias(name))
    return rows.groupBy(*keys).agg(*aggs)
