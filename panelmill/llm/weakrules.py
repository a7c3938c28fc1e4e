"""Quality rules under weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns estimates how often each
rule votes which way on good and on bad documents, and how common good ones are; the posterior probability of "good"
replaces the all-rules-must-pass filter. Spark counts the patterns (3 to the number of rules at most); the driver iterates
over that bounded table; the posterior is a sum of log odds by vote, a column expression again.

Rules are told apart from noise by voting together, so a kind of junk should show in two rules at least: symbols are counted
by the word they come with, by the words that hold one, and by the words without a letter that they make. A kind that shows in
one rule only, and rarely, may be taken for noise of that rule.

Defined cases: a null or empty text has 0 words and fails the base rule; a rule without evidence (no lines, no words)
abstains; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .textstats import with_text_stats

ITERATIONS = 50
BELIEF = 0.2  # weight of what is believed of the rules beforehand, in shares of the documents
GOOD, BAD, NONE = 1, 0, 2


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


def rules() -> dict[str, Column]:
    """name -> vote, over the columns of with_text_stats."""
    words, chars = F.col("n_words"), F.col("word_chars")
    some = words > 0
    return {
        "length": _vote(words < 50, words >= 100),
        "word_length": _vote(some & ((chars < 3 * words) | (chars > 12 * words)), some & (chars >= 4 * words) & (chars <= 9 * words)),
        "symbols": _vote(some & (10 * F.col("n_symbols") > words), some & (100 * F.col("n_symbols") <= words)),
        "marked": _vote(some & (10 * F.col("n_marked") > 3 * words), some & (50 * F.col("n_marked") <= words)),
        "lettered": _vote(some & (10 * F.col("n_lettered") < 8 * words), some & (10 * F.col("n_lettered") >= 9 * words)),
        "capitals": _vote(some & (10 * F.col("n_capitals") > 4 * chars), some & (10 * F.col("n_capitals") <= chars)),
        "dup_lines": _vote(10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), (F.col("n_lines") > 2) & (F.col("n_dup_lines") == 0)),
        "repeats": _vote(100 * F.col("n_repeat_words") > 30 * words, some & (100 * F.col("n_repeat_words") <= 10 * words)),
        "vocabulary": _vote((words >= 50) & (5 * F.col("n_distinct") < words), (words >= 50) & (3 * F.col("n_distinct") >= words)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> tuple[float, list[list[list[float]]]]:
    """Share of good documents and, by rule, class and vote, the probability of the vote. Starts from "no bad vote is good"."""
    weight = [0.9 if BAD not in votes else 0.1 for votes, _ in patterns]
    prior, table = 0.5, [[[0.5] * 2, [0.5] * 2] for _ in range(n_rules)]
    for _ in range(ITERATIONS):
        total = sum(n for _, n in patterns)
        good = sum(w * n for w, (_, n) in zip(weight, patterns, strict=True))
        prior = (good + 1) / (total + 2)
        for r in range(n_rules):
            # belief before any data: good documents hardly ever get a bad vote, bad ones get either
            sums = [[0.0] * 2, [0.0] * 2]
            sums[GOOD][BAD], sums[GOOD][GOOD] = 1 + 0.001 * BELIEF * total, 1 + 0.999 * BELIEF * total
            sums[BAD][BAD], sums[BAD][GOOD] = 1 + 0.5 * BELIEF * total, 1 + 0.5 * BELIEF * total
            for w, (votes, n) in zip(weight, patterns, strict=True):
                if votes[r] != NONE:  # abstaining says nothing about the document
                    sums[GOOD][votes[r]] += w * n
                    sums[BAD][votes[r]] += (1 - w) * n
            table[r] = [[x / sum(row) for x in row] for row in sums]
        weight = [1 / (1 + math.exp(-_odds(prior, table, votes))) for votes, _ in patterns]
    return prior, table


def _odds(prior: float, table: list, votes: tuple[int, ...]) -> float:
    got = math.log(prior / (1 - prior)) + sum(math.log(table[r][GOOD][v] / table[r][BAD][v]) for r, v in enumerate(votes) if v != NONE)
    return max(-30.0, min(30.0, got))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts of with_text_stats, votes, base_failed, p_good, kept."""
    stats = settle(with_text_stats(docs, marks=True), "quality-stats")
    named = rules()
    votes = stats.select("*", *[v.alias(f"vote_{n}") for n, v in named.items()])
    cols = [f"vote_{n}" for n in named]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    votes = votes.withColumn("base_failed", failed)
    # accuracies are learnt where a verdict is open; what fails the base rule would teach its own signs only
    counted = votes.where(~F.col("base_failed")).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** rules rows at most
    prior, table = fit(sorted((tuple(r[c] for c in cols), r["n"]) for r in counted), len(cols))
    odds = F.lit(math.log(prior / (1 - prior)))
    for c, by_class in zip(cols, table, strict=True):
        gain = [math.log(by_class[GOOD][v] / by_class[BAD][v]) for v in (BAD, GOOD)]
        odds = odds + F.when(F.col(c) == BAD, gain[0]).when(F.col(c) == GOOD, gain[1]).otherwise(0.0)
    scored = votes.withColumn("p_good", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
