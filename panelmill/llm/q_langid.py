from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import langid
from .common import crc_of_id, read
from .registry import register


def trained(docs: DataFrame) -> dict:
    """Model over the texts that are not held out (crc32 of the id, mod 5, is not 0)."""
    return langid.train(docs.where(F.coalesce(crc_of_id() % 5 != 0, F.lit(True))))


@register("op9_language_id")
def op9_language_id(spark, sf_dir):
    """Language of every document from its text alone: doc_id, held_out, lang_pred, score, n_spans."""
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs, trained(docs))
    return found.select(
        "doc_id",
        F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.size("spans").alias("n_spans"),
    )
