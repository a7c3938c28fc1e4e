"""Importance resampling towards a target corpus.

Words (and runs of up to GRAMS words) fall into BUCKETS buckets by crc32. The log ratio of a bucket's share in the target and
in all documents is its gain, an array by bucket; the weight of a document is the sum of the gains of its features,
repeats counted. Weight plus Gumbel noise drawn from the id is the score, and the highest scores are drawn: a sample
without replacement, by weight.

The cutoff is found without sorting all scores. A mergeable quantile sketch gives brackets of growing width around it; one pass
counts exactly what lies above and within each of them, the narrowest bracket that the counts confirm is taken (all scores, if
none is), and only its rows are sorted, over the cluster, to find the last drawn row. Ranks come from a range sort of the
drawn rows alone.

Defined cases: a null or empty text has no features and weight 0, and is not in the running with fewer than LEAST_WORDS words;
an empty target or table gives gains from the +1 counts alone; a missing id counts as empty text in the noise and comes
first among equal scores; rows equal in score and id are ranked in the order read; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hinted, settle

GRAMS = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACCURACY = 10_000  # of the sketch: ranks are off by up to 1 / ACCURACY of the rows
WIDTHS = (2, 8, 32, 256, 2048)  # of the brackets, in units of that error


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, BREAK), lambda w: w != "")


def _run_from(w: Column, n: int, slot: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda i: slot(F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """``keep`` columns, n_words, and slots: the bucket of every feature, repeats included."""
    at = docs.select(*keep, words_of(F.col("text")).alias("_w"))
    w = F.col("_w")
    slot = lambda c: (F.crc32(c.cast("binary")) % buckets).cast("int")
    runs = [F.transform(w, slot)]
    for n in range(2, grams + 1):
        places = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(places, _run_from(w, n, slot)))
    return at.select(*keep, F.size(w).cast("long").alias("n_words"), (F.concat(*runs) if len(runs) > 1 else runs[0]).alias("slots"))


def slot_counts(slots: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features in each bucket; partial sums are made in the tasks, and one number per bucket comes to the driver."""
    got = slots.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = [0] * buckets
    for r in got:
        counts[r["slot"]] = r["n"]
    return counts


def gains(target: list[int], every: list[int]) -> list[int]:
    """Thousandths of the log ratio of shares, one count added to each bucket."""
    k = len(every)
    t_all, s_all = float(sum(target) + k), float(sum(every) + k)
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for t, s in zip(target, every, strict=True)]


def scored(slots: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    weight = F.aggregate("slots", F.lit(0).cast("long"), lambda acc, s: acc + F.get(table, s))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    at = slots.select("doc_id", "n_words", F.size("slots").cast("long").alias("n_features"), weight.alias("weight"), noise.cast("long").alias("noise"))
    return at.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with ``name``: 1, 2, 3... in this order. A range sort over the cluster; one count per range is summed up."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number within a range is the low half of what the function gives in sorted ranges
    placed = settle(parts.select("*", F.monotonically_increasing_id().alias("_i")), "numbered")
    part, at = F.shiftright("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_p", part).join(hinted(settle(starts, "numbered-starts")), "_p").withColumn(name, F.col("_before") + at + 1).drop("_p", "_i", "_before")


def bracket(scores: DataFrame, draw: int, total: int) -> tuple[int | None, int | None, int]:
    """(low, high, above): the draw-th highest of ``score`` is in [low, high], and ``above`` rows are over high; exact counts confirm
    it. None for no bound."""
    q = 1 - draw / total
    shares = [min(1.0, max(0.0, q + side * w / ACCURACY)) for w in WIDTHS for side in (-1, 1)]
    cuts = scores.agg(F.percentile_approx("score", shares, ACCURACY).alias("c")).first()["c"]
    counts = [f for i, c in enumerate(cuts) for f in (F.count_if(F.col("score") > c).alias(f"above{i}"), F.count_if(F.col("score") >= c).alias(f"from{i}"))]
    got = scores.agg(*counts).first()
    for i in range(0, len(cuts), 2):
        if got[f"above{i + 1}"] < draw <= got[f"from{i}"]:
            return cuts[i], cuts[i + 1], got[f"above{i + 1}"]
    return None, None, 0


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row")]


def draw(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows of ``scores`` (settled; doc_id, n_words, score, row and others) with ``rank`` among the drawn, else null."""
    able = scores.where(F.col("n_words") >= least_words)
    total = able.count()
    wanted = percent * total // 100
    nothing = F.lit(None).cast("long")
    if wanted == 0:
        return scores.withColumn("rank", nothing)
    low, high, above = bracket(able, wanted, total)
    inside = able.select("doc_id", "score", "row") if low is None else able.where(F.col("score").between(low, high)).select("doc_id", "score", "row")
    last = numbered(inside, _order(), "place").where(F.col("place") == wanted - above).first()
    id_col = F.col("doc_id")
    after = id_col.isNotNull() if last["doc_id"] is None else F.coalesce(id_col > F.lit(last["doc_id"]), F.lit(False))
    out = (F.col("score") < last["score"]) | ((F.col("score") == last["score"]) & (after | (id_col.eqNullSafe(F.lit(last["doc_id"])) & (F.col("row") > last["row"]))))
    out = out | (F.col("n_words") < least_words)
    return numbered(scores.where(~out), _order(), "rank").unionByName(scores.where(out).withColumn("rank", nothing))


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank (1 is the highest drawn, null: not drawn)."""
    slots = settle(features(docs, ("doc_id",), grams, buckets), "importance-slots")
    gain = gains(slot_counts(features(target, (), grams, buckets), buckets), slot_counts(slots, buckets))
    scores = settle(scored(slots, gain, seed).withColumn("row", F.monotonically_increasing_id()), "importance-scores")
    return draw(scores, percent, least_words).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long"))
