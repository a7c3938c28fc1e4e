"""Data-quality rules over panel tables.

Every series (or the whole table) is one dataset.  Counts of all column rules
come from a single aggregate pass; duplicates, gaps and outliers add one pass
each.  The result is a long issue table plus a report per dataset.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axis import Axis, in_blocks
from ..functions.exprs import div, numeric_columns, total
from ..functions.quantiles import column_quantiles
from ..session import settle, written
from .joins import small

C = F.col
CRITICAL, ERROR, WARNING, INFO = "CRITICAL", "ERROR", "WARNING", "INFO"

# Points taken off the quality score per issue.
PENALTY = {CRITICAL: 25, ERROR: 10, WARNING: 5, INFO: 1}


@dataclass(frozen=True)
class Rules:
    required: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)


# Expectations per dataset type.
RULES = {
    "market": Rules(
        required=("open", "high", "low", "close"),
        numeric=("open", "high", "low", "close", "volume"),
        ranges={c: (0, None) for c in ("open", "high", "low", "close", "volume")},
    ),
    "sentiment": Rules(
        required=("sentiment_score",),
        numeric=("sentiment_score", "confidence"),
        ranges={"sentiment_score": (-1, 1), "confidence": (0, 1)},
    ),
    "economic": Rules(
        numeric=("DFF", "DGS10", "VIXCLS"),
        ranges={"DFF": (0, 50), "DGS10": (0, 50), "VIXCLS": (0, 100)},
    ),
    "unified": Rules(),
}
AT_ONCE = 100  # columns whose outliers are counted together
RATE_WORDS = ("rate", "yield", "dff", "dgs")
SUSPICIOUS = ("unnamed", "untitled", "column")


def _issue(cond: Column, severity: str | Column, category: str, column: str | None, message: Column, rows: Column | None = None, pct: Column | None = None) -> Column:
    none = lambda t: F.lit(None).cast(t)
    return F.when(
        cond,
        F.struct(
            (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
            F.lit(category).alias("category"),
            F.lit(column).cast("string").alias("column"),
            message.alias("message"),
            (rows.cast("bigint") if rows is not None else none("bigint")).alias("row_count"),
            (pct.cast("double") if pct is not None else none("double")).alias("percentage"),
        ),
    )


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _duplicates(df: DataFrame, by: list[str], on: list[str], out: str) -> DataFrame:
    """Rows beyond the first per ``on`` value, per dataset; copies fold on the map side."""
    copies = df.groupBy(*by, *on).agg((F.count(F.lit(1)) - 1).alias("_k"))
    return copies.groupBy(*by).agg(F.sum("_k").alias(out))


def _fingerprint(on: Sequence[str]) -> list[Column]:
    """128 bits of a row, as two numbers; equal rows have equal ones."""
    return [F.xxhash64(*[C(c) for c in on]), F.xxhash64(F.lit(7), *[C(c) for c in on])]


def duplicate_rows(
    df: DataFrame, by: Sequence[str], on: Sequence[str], out: str = "duplicates", fingerprint: Callable[[Sequence[str]], list[Column]] = _fingerprint, lazy: bool = False, first: Sequence[str] = ()
) -> DataFrame:
    """Rows equal in ``on`` to an earlier one, per dataset; datasets without any have no row.

    The shuffle carries the keys and 128 bits of each row, folded in the tasks before. Only rows whose bits occur twice are
    compared by their values, so equal bits alone make no copy. ``lazy`` runs no job while the plan is made. ``first`` names those
    of ``on`` that are cheap to have: equal rows are equal in these, so only datasets with such rows are looked at in full.
    """
    if first:
        c, d = fingerprint(first)
        alike = df.select(*by, c.alias("_fa"), d.alias("_fb")).groupBy(*by, "_fa", "_fb").agg(F.count(F.lit(1)).alias("_k")).filter(C("_k") > 1)
        alike = settle(alike.select(*by).distinct())
        if alike.isEmpty():
            return alike.withColumn(out, F.lit(0).cast("bigint"))
        df = df.join(small(alike), list(by), "left_semi")
    a, b = fingerprint(on)
    rows = df.select(*by, *on, a.alias("_fa"), b.alias("_fb"))
    twice = rows.groupBy(*by, "_fa", "_fb").agg(F.count(F.lit(1)).alias("_k")).filter(C("_k") > 1).drop("_k")
    keys = [*by, "_fa", "_fb"]
    renamed = (twice if lazy else settle(twice)).select(*[C(k).alias(f"_j{i}") for i, k in enumerate(keys)])
    renamed = renamed if lazy else small(renamed)
    same = reduce(lambda x, y: x & y, [C(k).eqNullSafe(C(f"_j{i}")) for i, k in enumerate(keys)])
    return _duplicates(rows.join(renamed, same, "left_semi"), list(by), list(on), out).filter(C(out) > 0)


def time_gaps(df: DataFrame, by: Sequence[str] = ("symbol",), ts: str = "ts", heavy: bool = False) -> DataFrame:
    """Per dataset: the commonest step in seconds (smallest on ties) and the steps above 1.5 times that."""
    axis = Axis(tuple(by), ts)
    seconds = F.unix_micros(C(ts).cast("timestamp")) / 1e6

    def step(d: DataFrame, a: Axis) -> DataFrame:
        return d.withColumn("_step", C("_sec") - a.lag("_sec"))

    times = df.select(*by, ts).withColumn("_sec", seconds)
    steps = in_blocks(times, axis, step, before=1) if heavy else step(times, axis)
    counts = steps.filter(C("_step").isNotNull()).groupBy(*by, "_step").agg(F.count(F.lit(1)).alias("_k"))
    modal = F.min_by("_step", F.struct(-C("_k"), C("_step"))).over(Window.partitionBy(*by))
    return counts.withColumn("expected", modal).groupBy(*by).agg(
        F.max("expected").alias("expected_step"), F.sum(F.when(C("_step") > C("expected") * 1.5, C("_k")).otherwise(0)).alias("gap_count")
    )


def outlier_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("symbol",), heavy: bool = False, lazy: bool = False) -> DataFrame:
    """Per dataset and column: known values, how many lie outside 1.5 interquartile ranges, and that range.

    The quartiles come first, the counts follow as one aggregate over rows that meet their dataset's bounds; rows stay rows,
    no column is turned into rows of its own. For datasets bounded by the calendar the quartiles are an aggregate (a counter
    per distinct value); with ``heavy`` they are selected by sketch and exact counts, so that a dataset of any size is
    spread over many tasks. Wide tables go a few columns at a time, each pass reading its columns only, as one aggregate over
    all of them would be too long to compile.
    """
    parts = [_outliers(df, list(columns[i : i + AT_ONCE]), list(by), heavy, lazy) for i in range(0, len(columns), AT_ONCE)]
    return reduce(lambda x, y: x.unionByName(y), parts)


def _outliers(df: DataFrame, columns: list[str], keys: list[str], heavy: bool, lazy: bool) -> DataFrame:
    span = range(len(columns))
    slim = df.select(*keys, *[C(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    if heavy:
        q = column_quantiles(slim, keys, [f"_x{i}" for i in span], {"lo": 0.25, "hi": 0.75})
        q = q.groupBy(*keys).agg(*[F.max(F.when(C("column") == f"_x{i}", F.array("lo", "hi"))).alias(f"_q{i}") for i in span])
    else:
        quarts = F.array(F.lit(0.25), F.lit(0.75))
        q = slim.groupBy(*keys).agg(*[F.percentile(f"_x{i}", quarts).alias(f"_q{i}") for i in span])
    lo, hi = (lambda i: C(f"_q{i}")[0]), (lambda i: C(f"_q{i}")[1])
    reach = lambda i: 1.5 * (hi(i) - lo(i))
    bounds = [x for i in span for x in ((lo(i) - reach(i)).alias(f"_l{i}"), (hi(i) + reach(i)).alias(f"_h{i}"), (hi(i) - lo(i)).alias(f"_r{i}"))]
    q = q.select(*keys, *bounds) if lazy else written(q.select(*keys, *bounds))
    near = q.select(*keys, *[f"_{s}{i}" for i in span for s in "lh"])
    near = near if lazy else small(near)
    far = lambda i: (C(f"_x{i}") < C(f"_l{i}")) | (C(f"_x{i}") > C(f"_h{i}"))
    aggs = [a for i in span for a in (F.count(f"_x{i}").alias(f"_n{i}"), F.count_if(far(i)).alias(f"_o{i}"))]
    if lazy:  # the range goes along with the rows, rather than the quartiles being worked out twice
        near, aggs = q, [*aggs, *[F.max(f"_r{i}").alias(f"_r{i}") for i in span]]
    per = slim.join(near, keys).groupBy(*keys).agg(*aggs)
    per = per if lazy else per.join(q.select(*keys, *[f"_r{i}" for i in span]), keys)
    cells = [F.struct(F.lit(c).alias("column"), C(f"_n{i}").alias("known"), C(f"_o{i}").alias("outliers"), C(f"_r{i}").alias("iqr")) for i, c in enumerate(columns)]
    return per.select(*keys, F.inline(F.array(*cells))).filter(C("known") > 0)


def _together(df: DataFrame, columns: Sequence[str], keys: Sequence[str], aggs: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(``aggs`` per dataset, its ``outlier_counts``) from one pass over rows that lie by dataset already.

    Quartiles are windows over the dataset and everything else is an aggregate of the same tasks, so no value is shuffled and
    rows worked out by windows over the same keys are worked out once. A row per dataset is written.
    """
    span, whole = range(len(columns)), Window.partitionBy(*keys)
    x, lo, hi = (lambda i: C(columns[i]).cast("double")), (lambda i: C(f"_q{i}")[0]), (lambda i: C(f"_q{i}")[1])
    quarts = F.array(F.lit(0.25), F.lit(0.75))
    rows = df.withColumns({f"_q{i}": F.percentile(x(i), quarts).over(whole) for i in span})
    far = lambda i: (x(i) < lo(i) - 1.5 * (hi(i) - lo(i))) | (x(i) > hi(i) + 1.5 * (hi(i) - lo(i)))
    cells = [a for i in span for a in (F.count(x(i)).alias(f"_v{i}"), F.count_if(far(i)).alias(f"_o{i}"), F.max(hi(i) - lo(i)).alias(f"_r{i}"))]
    per = written(rows.groupBy(*keys).agg(*aggs, *cells))
    found = [F.struct(F.lit(c).alias("column"), C(f"_v{i}").alias("known"), C(f"_o{i}").alias("outliers"), C(f"_r{i}").alias("iqr")) for i, c in enumerate(columns)]
    outliers = per.select(*keys, F.inline(F.array(*found))).filter(C("known") > 0) if columns else None
    return per.drop(*[f"_{s}{i}" for i in span for s in "vor"]), outliers


def validate(
    df: DataFrame,
    kind: str = "market",
    name: str = "dataset",
    by: Sequence[str] = ("symbol",),
    ts: str | None = "ts",
    ingest: str | None = None,
    now=None,
    heavy: bool = False,
    derived: bool = True,
    lazy: bool = False,
    cheap: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(issues, reports).  ``ingest`` is the arrival order used for the sortedness rule; ``now`` the clock.

    The rules read the table several times: a ``derived`` one is written first, a plain scan need not be. What they find is
    written as well, a row per dataset, so that issues and reports come from the same counts; with ``lazy`` they are plans that
    run when asked for, once for each of the two.

    ``heavy`` is for datasets not bounded by the calendar; without ``by`` it is always on.

    ``cheap`` is for wide rows worked out by windows over ``by``: they are neither written nor shuffled, but measured where they
    lie, in one pass. It names columns that stand without those windows, by which copies are looked for first.
    """
    rules = RULES[kind]
    keys = list(by) or ["_all"]
    fused = cheap is not None and bool(by) and not heavy and not lazy
    df = written(df) if derived and not lazy and not fused else df
    keep = (lambda d: d) if lazy else settle
    heavy = heavy or not by  # a whole table is one dataset of any size
    if not by:
        df = df.withColumn("_all", F.lit(1))
    values = [c for c in df.columns if c not in (*keys, ts, ingest)]
    numeric = [c for c in numeric_columns(df) if c in values]
    types = dict(df.dtypes)
    n = C("_n")
    aggs: list[Column] = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(C(c).isNull()).alias(f"_null_{c}") for c in values]
    aggs.append(F.count_if(total([C(c).isNull().cast("int") for c in values]) == len(values)).alias("_empty_rows"))
    found: list[Column] = []

    def count(label: str, cond: Column) -> Column:
        aggs.append(F.count_if(cond).alias(label))
        return C(label)

    # structure
    found.append(_issue(n == 0, CRITICAL, "structure", None, F.lit("Dataset is empty")))
    found.append(_issue((n > 0) & (n < 10), WARNING, "structure", None, _text("Only ", n, " rows"), n))
    unnamed = [c for c in values if c.startswith("Unnamed:")]
    if unnamed:
        found.append(_issue(n > 0, WARNING, "structure", None, F.lit(f"{len(unnamed)} unnamed columns")))
    # time
    if ts is None or types[ts] not in ("timestamp", "timestamp_ntz", "date"):
        found.append(_issue(n > 0, WARNING, "index", ts, F.lit("Time column is not a date or timestamp")))
    else:
        if types[ts] != "timestamp":
            found.append(_issue(n > 0, INFO, "index", ts, F.lit("Time column has no time zone")))
        aggs += [F.min(ts).alias("_first"), F.max(ts).alias("_last")]
        clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        day = lambda c: C(c).cast("date")
        found.append(_issue(day("_first") < F.lit("1990-01-01").cast("date"), WARNING, "index", ts, _text("First time is very early: ", day("_first"))))
        found.append(_issue(C("_last").cast("timestamp") > clock + F.expr("interval 7 days"), WARNING, "index", ts, _text("Last time is in the future: ", day("_last"))))
    # columns and types
    gone = [c for c in rules.required if c not in values]
    if gone:
        found.append(_issue(n > 0, ERROR, "columns", None, F.lit(f"Missing required columns: {', '.join(gone)}")))
    odd = [c for c in values if any(w in c.lower() for w in SUSPICIOUS)]
    if odd:
        found.append(_issue(n > 0, WARNING, "columns", None, F.lit(f"Suspicious column names: {', '.join(odd)}")))
    for c in rules.numeric:
        if c in values and c not in numeric:
            found.append(_issue(n > 0, ERROR, "data_types", c, F.lit(f"Column {c} should be numeric but is {types[c]}")))
    for c in rules.text:
        if c in numeric:
            found.append(_issue(n > 0, WARNING, "data_types", c, F.lit(f"Column {c} should be text but is {types[c]}")))
    for c in values:
        if types[c] == "string":
            bad = count(f"_words_{c}", C(c).isNotNull() & F.expr(f"try_cast(`{c}` AS double)").isNull())
            found.append(_issue((bad == 0) & (C(f"_null_{c}") < n), INFO, "data_types", c, F.lit(f"Column {c} is text but looks numeric")))
    # ranges
    for c, (lo, hi) in rules.ranges.items():
        if c not in values:
            continue
        shown = F.expr(f"try_cast(`{c}` AS double)")
        if lo is not None:
            k = count(f"_low_{c}", shown < lo)
            found.append(_issue(k > 0, ERROR, "value_ranges", c, _text(f"Column {c} has ", k, f" values below {lo}"), k, div(k, n) * 100))
        if hi is not None:
            k = count(f"_high_{c}", shown > hi)
            found.append(_issue(k > 0, ERROR, "value_ranges", c, _text(f"Column {c} has ", k, f" values above {hi}"), k, div(k, n) * 100))
    # missing data
    missing = div(total([C(f"_null_{c}") for c in values]), n * len(values)) * 100
    found.append(_issue(missing > 20, WARNING, "missing_data", None, F.lit("High share of missing data"), None, missing))
    found.append(_issue(C("_empty_rows") > 0, ERROR, "missing_data", None, _text(C("_empty_rows"), " rows hold no data"), C("_empty_rows")))
    # business rules; a price held as text is compared as the number it spells
    num = lambda c: C(c) if c in numeric else F.expr(f"try_cast(`{c}` AS double)")
    if kind == "market":
        if {"open", "high", "low", "close"} <= set(values):
            k = count("_hi_viol", num("high") < F.greatest(num("open"), num("close")))
            found.append(_issue(k > 0, ERROR, "business_logic", None, _text("High below open or close in ", k, " rows"), k))
            k = count("_lo_viol", num("low") > F.least(num("open"), num("close")))
            found.append(_issue(k > 0, ERROR, "business_logic", None, _text("Low above open or close in ", k, " rows"), k))
        if "volume" in values:
            k = count("_neg_vol", num("volume") < 0)
            found.append(_issue(k > 0, ERROR, "business_logic", "volume", _text("Negative volume in ", k, " rows"), k))
        for c in ("open", "high", "low", "close"):
            if c in values:
                k = count(f"_nonpos_{c}", num(c) <= 0)
                found.append(_issue(k > 0, ERROR, "business_logic", c, _text(f"Non-positive {c} in ", k, " rows"), k))
        if ts is not None:
            k = count("_weekend", F.weekday(C(ts).cast("date")) >= 5)
            found.append(_issue(k > 0, INFO, "time_series", None, _text(k, " weekend rows"), k))
    if kind == "sentiment":
        for c, lo in (("sentiment_score", -1), ("confidence", 0)):
            if c in values:
                k = count(f"_out_{c}", (C(c) < lo) | (C(c) > 1))
                found.append(_issue(k > 0, ERROR, "business_logic", c, _text(f"Column {c} out of range in ", k, " rows"), k))
    if kind == "economic":
        for c in numeric:
            if any(w in c.lower() for w in RATE_WORDS):
                k = count(f"_rate_{c}", (C(c) < 0) | (C(c) > 50))
                found.append(_issue(k > 0, WARNING, "business_logic", c, _text(f"Unreasonable rates in {c}: ", k, " rows"), k))

    if fused:
        base, outl = _together(df, numeric, keys, aggs)
    else:
        base = df.groupBy(*keys).agg(*aggs) if by else df.agg(*aggs).withColumn("_all", F.lit(1))
    # duplicates, order, gaps
    first = [c for c in values if c in cheap] if fused else []
    base = base.join(duplicate_rows(df, keys, values, "_dup_rows", lazy=lazy, first=first), keys, "left")
    found.append(_issue(C("_dup_rows") > 0, WARNING, "duplicates", None, _text(C("_dup_rows"), " duplicate rows"), C("_dup_rows"), div("_dup_rows", n) * 100))
    if ts is not None:
        base = base.join(_duplicates(df, keys, [ts], "_dup_ts"), keys, "left")
        found.append(_issue(C("_dup_ts") > 0, ERROR, "index", ts, _text(C("_dup_ts"), " duplicate times"), C("_dup_ts")))
    if ts is not None and kind != "sentiment":
        base = base.join(time_gaps(df, keys, ts, heavy), keys, "left")
        found.append(_issue(C("gap_count") > 0, WARNING, "time_series", None, _text(C("gap_count"), " gaps longer than expected"), C("gap_count")))
    if ts is not None and ingest is not None:
        arrival = Axis(tuple(keys), ingest)
        back = lambda d, a: d.withColumn("_back", (C(ts) < a.lag(ts)).cast("int"))
        seen = in_blocks(df, arrival, back, before=1) if heavy else back(df, arrival)
        base = base.join(seen.groupBy(*keys).agg(F.coalesce(F.sum("_back"), F.lit(0)).alias("_unsorted")), keys, "left")
        found.append(_issue(C("_unsorted") > 0, ERROR, "index", ts, F.lit("Times are not sorted")))

    base = keep(base)
    dataset = F.lit(name) if not by else F.concat_ws("/", F.lit(name), *[C(k).cast("string") for k in by])
    extra = ["_n", "_missing"]
    head = base.withColumn("_missing", F.when(n > 0, missing).otherwise(0.0))
    issues = head.select(*keys, dataset.alias("dataset"), F.inline(F.array_compact(F.array(*found))))
    # per-column gaps in long form: one small expression instead of one per column
    gaps = head.select(*keys, "_n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), C(f"_null_{c}").alias("_k")) for c in values])))
    share = div("_k", "_n") * 100
    issues = issues.unionByName(
        gaps.filter(share > 10).select(
            *keys,
            dataset.alias("dataset"),
            F.when(share > 50, ERROR).otherwise(WARNING).alias("severity"),
            F.lit("missing_data").alias("category"),
            "column",
            _text("Column ", C("column"), " has missing data").alias("message"),
            C("_k").cast("bigint").alias("row_count"),
            share.alias("percentage"),
        )
    )
    if numeric:
        share = C("outliers") / C("known") * 100
        level = F.when(share > 25, ERROR).when(share > 10, WARNING).otherwise(INFO)
        outl = outl if fused else keep(outlier_counts(df, numeric, keys, heavy, lazy))
        outl = outl.filter((C("known") > 10) & (C("iqr") > 0) & (C("outliers") > 0))
        issues = issues.unionByName(
            outl.select(
                *keys,
                dataset.alias("dataset"),
                level.alias("severity"),
                F.lit("outliers").alias("category"),
                "column",
                _text("Column ", C("column"), " has ", C("outliers"), " outliers").alias("message"),
                C("outliers").cast("bigint").alias("row_count"),
                share.alias("percentage"),
            )
        )
    reports = report(head.select(*keys, dataset.alias("dataset"), *extra), issues, keys)
    drop = [] if by else ["_all"]
    return issues.drop(*drop), reports.drop(*drop)


def report(sizes: DataFrame, issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per dataset: issue counts, quality score, validity."""
    counts = issues.groupBy(*keys).agg(*[F.count_if(C("severity") == s).alias(f"{s.lower()}_issues") for s in PENALTY])
    out = sizes.join(counts, list(keys), "left")
    names = [f"{s.lower()}_issues" for s in PENALTY]
    out = out.withColumns({c: F.coalesce(C(c), F.lit(0)) for c in names})
    lost = total([C(f"{s.lower()}_issues") * p for s, p in PENALTY.items()])
    return out.select(
        *keys,
        "dataset",
        C("_n").alias("rows"),
        *names,
        total([C(c) for c in names]).alias("total_issues"),
        C("_missing").alias("missing_pct"),
        F.greatest(F.lit(0.0), F.lit(100.0) - lost - C("_missing") * 0.5).alias("quality_score"),
        (C("critical_issues") == 0).alias("is_valid"),
        ((C("critical_issues") == 0) & (C("warning_issues") == 0)).alias("is_valid_strict"),
    )


def validate_market(df: DataFrame, **kw):
    return validate(df, "market", kw.pop("name", "market"), **kw)


def validate_sentiment(df: DataFrame, **kw):
    return validate(df, "sentiment", kw.pop("name", "sentiment"), **kw)


def validate_economic(df: DataFrame, **kw):
    return validate(df, "economic", kw.pop("name", "economic"), **kw)


def validate_unified(df: DataFrame, **kw):
    return validate(df, "unified", kw.pop("name", "unified"), **kw)


def of_severity(issues: DataFrame, severity: str) -> DataFrame:
    return issues.filter(C("severity") == severity)


def has_critical(issues: DataFrame) -> bool:
    return not of_severity(issues, CRITICAL).isEmpty()


def validation_summary(reports: DataFrame) -> DataFrame:
    """Reports, reports with critical issues, mean score (100 when there are none)."""
    return reports.agg(
        F.count(F.lit(1)).alias("reports"),
        F.count_if(C("critical_issues") > 0).alias("with_critical"),
        F.coalesce(F.avg("quality_score"), F.lit(100.0)).alias("average_score"),
    )
