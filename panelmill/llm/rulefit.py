"""Quality classifier: a sparse ensemble of rules.

Shallow trees grown on text statistics give conjunctive rules (every path from a root); a lasso logistic fit over the
rules leaves weights on few of them; those are compiled into one Spark column expression that scores every document.

The fit sees a bounded sample of labelled rows (``rows``, chosen by a hash of the id). Defined cases: null and empty
texts are scored from zero counts; labels that are null or missing are not learnt from, repeated labels count each; with
no labels, or one class only, the score is the smoothed share of label 1; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

SAMPLE_ROWS = 20_000
TREES, DEPTH, PENALTY = 10, 3, 0.001


def features() -> dict[str, Column]:
    """Statistics the trees may split on, over the columns of with_text_stats."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"),
        "pipes": per("n_pipes", "n_words"),
        "capitals": per("n_capitals", "word_chars"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "distinct": per("n_distinct", "n_words"),
        "line_words": per("n_words", "n_lines"),
    }


def _rules(model, names: list[str]) -> list[tuple[tuple[str, str, float], ...]]:
    """Every path from a root to an inner node's child, as (feature, sign, threshold) conditions; equal ones once."""
    found: dict[tuple, None] = {}
    for tree in model.trees:
        todo = [(tree._call_java("rootNode"), ())]
        while todo:
            node, path = todo.pop()
            if path:
                found.setdefault(tuple(sorted(path)))
            if node.subtreeDepth() > 0:
                split = node.split()
                name, cut = names[split.featureIndex()], float(split.threshold())
                todo.append((node.leftChild(), (*path, (name, "<=", cut))))
                todo.append((node.rightChild(), (*path, (name, ">", cut))))
    return list(found)


def _column(rule: tuple[tuple[str, str, float], ...]) -> Column:
    out = F.lit(True)
    for name, sign, cut in rule:
        out = out & (F.col(name) <= cut if sign == "<=" else F.col(name) > cut)
    return out


class RuleModel:
    """A bias and weighted rules."""

    def __init__(self, bias: float, weights: list[tuple[tuple, float]]):
        self.bias, self.weights = bias, weights

    def score(self) -> Column:
        odds = F.lit(self.bias)
        for rule, weight in self.weights:
            odds = odds + F.when(_column(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    def describe(self) -> list[str]:
        return [f"{weight:+.3f} if " + " and ".join(f"{n} {s} {c:.4g}" for n, s, c in rule) for rule, weight in sorted(self.weights, key=lambda x: -abs(x[1]))]


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> RuleModel:
    """labelled: the feature columns, ``label`` (0 or 1) and ``doc_id``; at most about ``rows`` of them are used."""
    names = list(features())
    by_label = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, positive = sum(by_label.values()), by_label.get(1, 0)
    if len(by_label) < 2:
        p = (positive + 1) / (n + 2)
        return RuleModel(math.log(p / (1 - p)), [])
    share = int(min(1.0, rows / n) * 1_000_000)
    sample = settle(labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).select(*names, F.col("label").cast("double").alias("label")).coalesce(2), "rule-sample")
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="0.6", subsamplingRate=0.7, seed=seed)
    rules = _rules(forest.fit(VectorAssembler(inputCols=names, outputCol="x").transform(sample)), names)
    if not rules:
        p = (positive + 1) / (n + 2)
        return RuleModel(math.log(p / (1 - p)), [])
    cols = [f"r{i}" for i in range(len(rules))]
    fired = sample.select("label", *[_column(r).cast("double").alias(c) for r, c in zip(rules, cols, strict=True)])
    fired = settle(VectorAssembler(inputCols=cols, outputCol="x").transform(fired).select("label", "x"), "rule-matrix")
    lasso = LogisticRegression(labelCol="label", featuresCol="x", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(fired)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if abs(w) > 1e-6]
    return RuleModel(float(lasso.intercept), weights)
