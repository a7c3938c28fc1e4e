"""Fill-in-the-middle transformation with one counted match per row.

``regexp_count`` gives the number n of units in a text. Two hashes of the id pick two cuts a <= b of 0 to n units, and a
pattern made for the row, ``\\A((?:unit){a}+)((?:unit){b-a}+)(.*+)\\z``, takes prefix, middle and suffix apart in one match; the
replacement puts them back in the order of the form. The possessive counts make the matcher walk once ahead, without a
stack or a way back. The same kind of match, over the markers, restores the text.

Defined cases: a null text is empty, and an empty text stays plain; a text that holds a marker stays plain, as it could not
be taken apart again; a missing id counts as empty text, and rows of equal ids are cut by the same hashes; other columns
stay if named in ``keep``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PLAIN_SHARE = 10  # percent of texts that stay as they are
SPM_SHARE = 20  # percent of the others that start with the suffix
# a unit never matches nothing, and units follow each other without gaps; lines take their line feed along
CHARACTER, WORD, LINE = r"(?s:.)", r"(?:\s*+\S++(?:\s++\z)?+|\s++\z)", r"(?:[^\n]*+\n|[^\n]++\z)"


def hashes(doc_id: str | Column = "doc_id", seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of ``seed:doc_id``."""
    name = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def infilled(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), unit: str = CHARACTER, seed: int = SEED, plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """``keep`` columns as a struct ``kept``, and n (units), form (plain, psm, spm), a and b (units before the middle and up to its
    end; null if plain), text and output."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = hashes(seed=seed)
    at = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), text.alias("text"), *[x.alias(f"h{i}") for i, x in enumerate(h, 1)])
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain_share)
    at = at.select("*", F.regexp_count("text", F.lit(unit)).cast("long").alias("n"), F.when(plain, "plain").when(F.col("h4") % 100 < spm_share, "spm").otherwise("psm").alias("form"))
    cut = [F.when(F.col("form") != "plain", F.col(h) % (F.col("n") + 1)) for h in ("h1", "h2")]
    at = at.select("kept", "text", "n", "form", F.least(*cut).alias("a"), F.greatest(*cut).alias("b"))
    pattern = F.concat(F.lit(rf"\A((?:{unit}){{"), F.col("a"), F.lit(rf"}}+)((?:{unit}){{"), F.col("b") - F.col("a"), F.lit(r"}+)((?s:.*+))\z"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    made = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace(F.col("text"), pattern, order))
    return at.select("*", made.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. No part holds a marker, so the first of each kind is the one set."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document, cut by code points."""
    made = infilled(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        F.col("kept.doc_id").alias("doc_id"),
        "n",
        "form",
        F.col("a").alias("prefix_chars"),
        (F.col("b") - F.col("a")).alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
