"""Counts over whole texts, as column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
POSITION_BITS = 30  # a Spark string holds under 2**31 bytes, so under 2**30 words


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _neighbour_equal(rows: Column, same) -> Column:
    """Elements of a sorted array that equal the one before or after by ``same``."""
    return F.filter(rows, lambda x, i: F.coalesce(same(x, F.get(rows, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(rows, i + 1)), F.lit(False)))


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


def with_text_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), marks: bool = False) -> DataFrame:
    """``keep`` columns and, for the whole text (null: empty): n_chars, n_words, word_chars, n_symbols, n_pipes, n_capitals,
    n_lines (with a word), n_dup_lines (equal to an earlier line), n_distinct (words), n_repeat_words (words inside
    three-word windows that occur twice or more in the text), and with ``marks`` n_marked (words that hold a symbol) and
    n_lettered (words that hold a letter).

    Repeated windows: 34 bits of each window's hash are sorted together with its position; windows that share those bits
    are compared by their words, so equal bits alone count for nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = (1 << POSITION_BITS) - 1
    at = docs.select(*keep, text.alias("text"))
    # kept in steps: an array that a lambda reads by index must be a column, not an expression evaluated again each time
    at = at.select(
        *keep,
        F.length("text").cast("long").alias("n_chars"),
        _without(F.col("text"), BLANKS).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))).cast("long").alias("n_pipes"),
        (F.length("text") - _without(F.col("text"), CAPITALS)).cast("long").alias("n_capitals"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("_lines"),
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("_w"),
    )
    w = F.col("_w")
    packed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    kinds = {"n_marked": f"[{SYMBOLS}]", "n_lettered": r"\p{L}"} if marks else {}
    at = at.select(
        "*",
        *[F.size(F.filter("_w", _matches(kind))).cast("long").alias(c) for c, kind in kinds.items()],
        F.size("_w").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.when(F.size("_w") > 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")).alias("_p"),
    ).drop("_lines")
    like = _neighbour_equal(F.col("_p"), lambda a, b: F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS))
    at = at.withColumn("_p", like)
    window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    place = F.transform("_p", lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
    at = at.withColumn("_k", F.sort_array(F.transform(place, lambda i: F.struct(window(i).alias("k"), i.alias("i"))))).drop("_w", "_p")
    again = _neighbour_equal(F.col("_k"), lambda a, b: a["k"] == b["k"])
    at = at.withColumn("_k", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_k", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_k", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return at.withColumn("n_repeat_words", covered.cast("long")).drop("_k")
