"""The corpus pipeline: each stage reads what the one before it wrote.

All stages but the last return the columns of documents. Language ID drops documents without a letter or without a
likely language; of near-duplicates the document of the least id stays; repeated strings are cut out of the texts; the mix
repeats and drops documents; packing returns the pieces of the sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import jaccard, langid, mixing, packing, repeats
from panelmill.llm.common import read, settle
from panelmill.llm.q_langid import trained
from panelmill.llm.q_packing import TOKENIZER

LEAST_SCORE = 0.2  # of a language


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the documents themselves have taught."""
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest")  # whatever their names are
    found = langid.identify(docs.select(rest, "text"), trained(docs), ("_rest", "text"))
    likely = found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE))
    return likely.select(*[F.col(c) if c == "text" else F.col(f"_rest.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of repeats.PASSAGE bytes (prose of some 45 words) that occur more than once."""
    return repeats.without_repeats(docs, repeats.PASSAGE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources", mixture),
    ("packing", packs),
]
ORACLE_SQL = None  # hashing, suffix sorting and differencing have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
