"""Order MinHash fingerprints.

Every k-mer of a text is numbered by its occurrence, so that repeats are different elements. The hash of (k-mer, number)
deals the elements to BINS bins; in each bin the PICK elements of smallest hash are put back in text order and their
k-mers are hashed as a tuple. A fingerprint is the list of these hashes; two agree in a bin when both texts have the same
minimal k-mers in the same order there, which, unlike a set overlap, notices that parts have moved.

Defined cases: a null text is empty; a text shorter than K is its own only k-mer; an empty text has an empty fingerprint
(all bins blank), alike to another empty one (1) and unlike the rest (0); equal texts have equal fingerprints; the next
document goes by ascending doc_id, nulls first, equal ids by text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import hinted, mix64, settle, slices

K, BINS, PICK = 9, 64, 2
BIN_BITS = 6  # 2 ** BIN_BITS = BINS
ROWS_PER_RANGE, MOST_RANGES = 500, 50_000


def signature(text: str) -> np.ndarray:
    """BINS numbers under 2**16; 0 marks a bin without k-mers."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(cps):
        return np.zeros(BINS, np.uint16)
    k = min(K, len(cps))
    n = len(cps) - k + 1
    kmer = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            kmer = kmer * np.uint64(0x9E3779B97F4A7C15) + cps[j : j + n]
        kmer = mix64(kmer + np.uint64(k))
        bits = np.uint64(max(int(n).bit_length(), 1))
        place = (np.uint64(1) << bits) - np.uint64(1)
        order = np.sort((kmer & ~place) | np.arange(n, dtype=np.uint64))
        at = (order & place).astype(np.int64)
        fresh = np.ones(n, bool)
        fresh[1:] = (order[1:] >> bits) != (order[:-1] >> bits)
        index = np.arange(n)
        nth = index - np.maximum.accumulate(np.where(fresh, index, 0))
        rank = mix64(kmer[at] ^ mix64(nth.astype(np.uint64) + np.uint64(1)))
        box = (rank >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        small = _small(rank, box, n)
        at, rank, box = at[small], rank[small], box[small]
        by = np.argsort(rank, kind="stable")
        at, box = at[by], box[by]
        start = np.searchsorted(box, np.arange(BINS + 1))
        pick = start[:-1, None] + np.arange(PICK)
        there = pick < start[1:, None]
        spots = np.sort(np.where(there, at[np.minimum(pick, len(at) - 1)], n), axis=1)
        mers = np.where(spots < n, kmer[np.minimum(spots, n - 1)], np.uint64(0))
        out = np.zeros(BINS, np.uint64)
        for j in range(PICK):
            out = mix64(out * np.uint64(31) + mers[:, j] + np.uint64(1))
    return np.where(there[:, 0], out % np.uint64(65_535) + np.uint64(1), 0).astype(np.uint16)


def _small(rank: np.ndarray, box: np.ndarray, n: int) -> np.ndarray:
    """Elements that may be among the smallest of their bin: those under a bound that every bin meets PICK times, else all."""
    expect = 12 * BINS
    if n > 2 * expect:
        with np.errstate(over="ignore"):
            low = (rank << np.uint64(BIN_BITS)) < np.uint64(int(2**64 * (expect / n)))
        if np.bincount(box[low], minlength=BINS).min() >= PICK:
            return np.flatnonzero(low)
    return np.arange(n)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the share of agreeing bins among those that either text fills, per element of a tuple."""
    filled = (a > 0) | (b > 0)
    return float(np.mean((a == b)[filled]) ** (1 / PICK)) if filled.any() else 1.0


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def _as_number(rows: DataFrame) -> Column:
    """The id as a number in the same order, or nearly: for ids as text, the six bytes behind what all of them begin with."""
    if not isinstance(rows.schema["doc_id"].dataType, StringType):
        return F.col("doc_id").cast("double")
    low, high = (x.encode() if x is not None else b"" for x in rows.agg(F.min("doc_id"), F.max("doc_id")).first())
    same = len(os.path.commonprefix([low, high]))
    digits = F.rpad(F.hex(F.substring(F.encode("doc_id", "utf-8"), same + 1, 6)), 12, "0")
    return F.when(F.col("doc_id").isNotNull(), F.conv(digits, 16, 10).cast("double"))


def in_ranges(docs: DataFrame) -> DataFrame:
    """(rng, ahead, doc_id, text) dealt by ranges of doc_id and sorted; each range ends with a copy of the row that comes
    next after it (ahead = 1), the last range with a copy of the first row. Ranges follow approximate quantiles of the
    ids, which only shape the work: any bounds give the same pairs."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce(_as_number(rows), F.lit(float("-inf")))
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE))
    inner: list[float] = []
    if ranges > 1:
        cuts = [i / ranges for i in range(1, ranges)]
        got = rows.select(F.percentile_approx(key, cuts, min(20 * ranges, 1_000_000)).alias("q")).head()["q"]
        inner = sorted({x for x in got if x > float("-inf")})
    rows = rows.withColumn("_key", key)
    if inner:
        rows = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="_key", outputCol="_rng").transform(rows).withColumn("rng", F.col("_rng").cast("int"))
    else:
        rows = rows.withColumn("rng", F.lit(0))
    rows = rows.select("rng", "doc_id", "text")
    firsts = settle(rows.groupBy("rng").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("f")).select(F.col("rng").alias("_r"), F.col("f.doc_id").alias("_d")), "omh-firsts")
    at_first = rows.join(hinted(firsts), (F.col("rng") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    heads = settle(at_first.groupBy("rng", "doc_id").agg(F.min("text").alias("text")), "omh-heads")
    used = sorted(r["rng"] for r in heads.select("rng").collect())  # MOST_RANGES numbers at most
    if not used:
        return rows.select("rng", F.lit(0).alias("ahead"), "doc_id", "text")
    before = docs.sparkSession.createDataFrame([(b, a) for a, b in zip(used, used[1:] + used[:1], strict=True)], "_h int, _before int")
    heads = heads.join(F.broadcast(before), F.col("rng") == F.col("_h"))  # MOST_RANGES rows at most
    every = rows.select("rng", F.lit(0).alias("ahead"), "doc_id", "text").unionByName(heads.select(F.col("_before").alias("rng"), F.lit(1).alias("ahead"), "doc_id", "text"))
    return every.repartition("rng").sortWithinPartitions("rng", "ahead", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited
    text has its last quarter replaced by the beginning of the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, id, text, signature) of the row that waits for the next one
        for batch in slices(batches):
            out = []
            for rng, ahead, doc_id, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                mine = signature(text)
                if held is not None and held[0] == rng:
                    _, prev, old, sig = held
                    quarter = len(old) // 4
                    edited = old[: len(old) - quarter] + text[:quarter]
                    changed = signature(edited)
                    out.append((prev, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(sig), as_text(changed), likeness(sig, changed), likeness(sig, mine)))
                held = None if ahead else (rng, doc_id, text, mine)
            if out:
                kinds = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    kind = dict(docs.dtypes)["doc_id"]
    return in_ranges(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
