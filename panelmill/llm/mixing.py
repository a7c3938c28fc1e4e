"""Mixing sources to target weights with hash-threshold histograms.

Every source gets a budget of words. Whole copies cover the budget's multiple of the source; the rest is taken from
documents whose hash lies under a threshold. The threshold is found from histograms of words by (source, hash bucket):
the bucket in which the running sum passes the budget is cut into finer buckets, again and again, until it holds one hash
value. No document is sorted, and the sets of two budgets are nested.

Defined cases: a null text has size 0; null is a source of its own and the last one; rows equal in doc_id (or without one) and
in text fall under the threshold together, other rows of one doc_id do not; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hinted, settle

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS = 12
LEVELS = 5  # 60 bits of hash
CAP = 3


def doc_hash() -> Column:
    """60 bits of md5 over the id as text (missing: empty) and the md5 of the text, so that rows of one id fall apart."""
    name, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    both = F.concat(name, F.lit("/"), F.md5(text.cast("binary")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Budget of each source: weights 1, 2, 3 repeating by source name, null last, capped at CAP times the source.

    One row per source is all that the unpartitioned windows here ever see. With sources in order of cap / weight, those
    that reach their cap are a prefix; the rest share what is left by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    per = per.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * CAP)
    # cap / weight as a whole number of sixths, so that the order is exact
    level = F.col("cap") * F.lit(6) / F.col("weight")
    before = W.orderBy("level", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    per = (
        per.withColumn("level", level.cast("long"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("budget", F.sum("source_size").over(every))
        .withColumn("weights", F.sum("weight").over(every))
    )
    share = (F.col("budget") - F.col("cap_before")).cast("double") * F.col("weight") / (F.col("weights") - F.col("weight_before"))
    per = per.withColumn("capped", F.col("cap") <= share)
    # once a source stays under its cap, so do all after it; they share by the weights from the first of them on
    free = F.min(F.when(~F.col("capped"), F.struct("level", "cap_before", "weight_before"))).over(every)
    per = per.withColumn("free", free)
    rest = (F.col("budget") - F.col("free.cap_before")).cast("double") * F.col("weight") / (F.col("weights") - F.col("free.weight_before"))
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(rest).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, copies, below): a document counts copies times, and once more if its hash is under ``below``."""
    todo = targets.select(
        "source",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("copies"),
        "source_size",
        "target",
    ).select("source", "copies", F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long").alias("budget"))
    at = settle(todo.withColumn("prefix", F.lit(0).cast("long")).withColumn("left", F.col("budget")).drop("budget"), "mix-level")
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        at = settle(_refine(sizes, at, shift), "mix-level")
    # the last boundary value joins the taken ones when that comes nearer to the budget
    return at.select("source", "copies", F.when(F.col("left") * 2 >= F.col("at_size"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))


def _refine(sizes: DataFrame, at: DataFrame, shift: int) -> DataFrame:
    """One level down: sums by bucket inside each source's boundary bucket, and the bucket where the budget runs out."""
    bucket = F.shiftright("hash", shift)
    mine = hinted(at.select(F.col("source").alias("_s"), "copies", "prefix", "left"))
    inside = sizes.join(mine, F.col("source").eqNullSafe(F.col("_s"))).where(F.shiftright(F.col("hash"), shift + LEVEL_BITS) == F.col("prefix"))
    sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("words").over(run))
    found = (
        sums.join(at.select(F.col("source").alias("_s"), "left"), F.col("source").eqNullSafe(F.col("_s")))
        .where(F.col("upto") > F.col("left"))
        .groupBy("source")
        .agg(F.min_by(F.struct("bucket", "words", "upto"), "bucket").alias("b"))
        .select(F.col("source").alias("_f"), "b")
    )
    top = (F.lit(1).cast("long") * (1 << LEVEL_BITS)) * (F.col("prefix") + 1)
    return at.join(found, F.col("source").eqNullSafe(F.col("_f")), "left").select(
        "source",
        "copies",
        F.coalesce(F.col("b.bucket"), top).alias("prefix"),  # nothing overruns: everything in the bucket is taken
        F.coalesce(F.col("left") - (F.col("b.upto") - F.col("b.words")), F.lit(-1)).cast("long").alias("left"),
        F.coalesce(F.col("b.words"), F.lit(1)).cast("long").alias("at_size"),
    )


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash) of every document; the text is read once, here."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), doc_hash().alias("hash"))


def shares(sizes: DataFrame) -> DataFrame:
    """(_s, source_size, target, copies, below) of each source, settled."""
    targets = settle(source_targets(sizes), "mix-targets")
    rule = thresholds(sizes, targets).select(F.col("source").alias("_r"), "copies", "below")
    per = targets.join(rule, F.col("source").eqNullSafe(F.col("_r"))).select(F.col("source").alias("_s"), "source_size", "target", "copies", "below")
    return settle(per, "mix-rule")


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words the mix takes of it)."""
    sizes = settle(sized(docs), "mix-sizes")
    return sizes.join(hinted(shares(sizes)), F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("copies") + (F.col("hash") < F.col("below")).cast("long"))).alias("taken"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows it does not take are left out."""
    sizes = settle(sized(docs), "mix-sizes")
    rule = hinted(shares(sizes).select(F.col("_s").alias("_mix_source"), F.col("copies").alias("_mix_copies"), F.col("below").alias("_mix_below")))
    times = (F.col("_mix_copies") + (doc_hash() < F.col("_mix_below")).cast("long")).cast("int")
    rows = docs.join(rule, F.col("source").cast("string").eqNullSafe(F.col("_mix_source"))).withColumn("_mix_times", times).where("_mix_times > 0")
    return rows.withColumn("_mix_again", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(*docs.columns)
