from __future__ import annotations

from pyspark.sql import functions as F

from . import rulefit
from .common import crc_of_id, read, settle
from .registry import register
from .textstats import with_text_stats


@register("op4_quality_classifier")
def op4_quality_classifier(spark, sf_dir):
    """Quality score of every document: doc_id, held_out, score, predicted."""
    stats = with_text_stats(read(spark, sf_dir, "documents"))
    table = settle(stats.select("doc_id", *[c.alias(n) for n, c in rulefit.features().items()]), "quality-features")
    held = F.coalesce(crc_of_id() % 3 == 1, F.lit(False))
    labels = read(spark, sf_dir, "labels").where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    model = rulefit.fit(table.join(labels, "doc_id").where(~held))
    scored = table.select("doc_id", held.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
