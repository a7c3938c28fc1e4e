"""Connected components of a graph held as an edge table, by alternating star contraction.

Each round every node passes its least neighbour on to the larger ones (large star) and then to all smaller or equal ones
(small star); rounds are written to the shared folder and end when the edges no longer change. Nothing is collected but
two sums over the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a long, b long): the label is the component's least node."""
    at = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        seen = at.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).head()
        if not seen["n"] or tuple(seen) == before:
            break
        before = tuple(seen)
        # large star: over all neighbours, to the larger ones
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: over the smaller neighbours, to them and itself
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        at = settle(small.where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    up = at.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return up.unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
