"""N-gram Jaccard join by MinHash bands.

Every text becomes the set of its N-word windows and BANDS x ROWS minimal hashes of it. Bands and rows are chosen so that
two texts at the threshold share a band with probability ``recall``. Texts with equal sets are one node. The shuffle is on
band hashes: nodes that share one are joined to the least of them, and connected groups of candidates form. Each group
gets every member's full set once, and all its pairs at the threshold are found there exactly, by the rarest elements of
each set first (a pair at the threshold shares one of them). Groups whose sets are too large for a task are dealt out as
blocks, every pair of blocks in a task of its own. Pairs are counted and united where they are found, not listed.

Defined cases: null and blank texts have no windows: they are one class and have no links; a text of under N words is one
window; equal texts share a class whatever their ids; rows with equal or null ids are rows like others; the class id is
the least doc_id of the class, null if there is none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, flagged, mix64, settle, slices
from .components import components
from .repeats import SEEN, keyed

N = 5
THRESHOLD = 0.8
RECALL = 0.9998
ROWS = 8
BLOCK_WINDOWS = 3_000_000  # windows of the sets that one side of a task holds


def bands_for(threshold: float, recall: float, rows: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(text: str, n: int = N) -> np.ndarray:
    """Hashes of the distinct n-word windows, sorted."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    codes: dict[str, int] = {}
    index = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    hashed = np.fromiter((_word(w) for w in codes), np.uint64, len(codes))[index]
    k = min(n, len(words))
    size = len(words) - k + 1
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashed[j : j + size])
    return np.unique(out)


def _word(w: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of minimal hashes."""
    many = bands * rows
    index = np.arange(1, many + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        times, plus = mix64(index * np.uint64(0xA0761D6478BD642F)) | np.uint64(1), mix64(index * np.uint64(0xE7037ED1A0B428DB))
        low = np.full(many, 2**64 - 1, np.uint64)
        for a in range(0, len(grams), 1024):
            low = np.minimum(low, (grams[a : a + 1024, None] * times + plus).min(axis=0))
        out = np.arange(bands, dtype=np.uint64)
        for row in low.reshape(bands, rows).T:
            out = mix64(out * np.uint64(31) + row)
    return out


def _identity(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers."""
    with np.errstate(over="ignore"):
        one, two = mix64(grams + np.uint64(11)).sum(dtype=np.uint64), mix64(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int((two ^ np.uint64(len(grams))).astype(np.int64))


def _described(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, d, e, s1, s2 (of its set), n, bands of every row; a set a task has had before comes without bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches):
            cols: list[list] = [[], [], [], []]
            for text in batch.column(3):
                grams = shingles(text.as_py(), n)
                key = _identity(grams)
                if len(seen) >= SEEN:
                    seen.clear()
                fresh = len(grams) and key not in seen
                seen.add(key)
                for col, x in zip(cols, (key[0], key[1], len(grams), signature(grams, bands, rows).view(np.int64) if fresh else None), strict=True):
                    col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "d", "e", "s1", "s2", "n", "bands"])

    kind = dict(texts.dtypes)["doc_id"]
    return texts.select("doc_id", "d", "e", "text").mapInArrow(run, f"doc_id {kind}, d long, e long, s1 long, s2 long, n int, bands array<long>")


def similar_pairs(sets: list[np.ndarray], side: np.ndarray | None, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, indexes of smaller or equal sets) at the threshold; with sides, only pairs across them."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, element, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.empty(len(often), np.int64)
    rarity[np.argsort(often, kind="stable")] = np.arange(len(often))
    shared = often[element] > 1
    first = np.concatenate([[0], np.cumsum(size)])
    prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    alone = np.bincount(owner[~shared], minlength=len(sets))
    element, owner = rarity[element[shared]], owner[shared]
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))])
    holders: dict[int, list[int]] = {}
    mark = np.zeros(len(rarity), bool)
    for i in np.argsort(size, kind="stable").tolist():
        mine = np.sort(element[first[i] : first[i + 1]])
        head = mine[: max(0, int(prefix[i] - alone[i]))].tolist()
        found = {j for x in head for j in holders.get(x, ())}
        for x in head:
            holders.setdefault(x, []).append(i)
        if not found:
            continue
        near = np.fromiter(found, np.int64, len(found))
        near = near[size[near] >= threshold * size[i] - 1e-9]
        if side is not None:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        mark[mine] = True
        spans = [element[first[j] : first[j + 1]] for j in near.tolist()]
        counts = np.array([len(s) for s in spans])
        both = np.add.reduceat(np.append(mark[np.concatenate(spans)], False), np.concatenate([[0], np.cumsum(counts)[:-1]])) if counts.sum() else np.zeros(len(near))
        both = np.where(counts > 0, both, 0)
        mark[mine] = False
        # whole numbers: both / (size_i + size_j - both) >= threshold
        ok = both >= threshold * (size[i] + size[near] - both) - 1e-9
        if ok.any():
            yield i, near[ok]


def _verified(dealt: DataFrame, threshold: float) -> DataFrame:
    """(s1, s2, r1, r2, links): a set's root in its task's group and the documents it is linked to there."""

    def solve(i: int, j: int, rows: list[tuple]) -> list[tuple]:
        one = {(r[0], r[1]): r for r in rows}
        rows = list(one.values())
        if len(rows) < 2 or (i != j and len({r[2] for r in rows}) < 2):  # one block only: its pairs are those of (i, i)
            return []
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        side = np.array([r[2] for r in rows])
        weight = np.array([r[3] for r in rows], np.int64)
        links = np.zeros(len(rows), np.int64)
        root = list(range(len(rows)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, near in similar_pairs(sets, side if i != j else None, threshold):
            links[x] += weight[near].sum()
            links[near] += weight[x]
            for y in near.tolist():
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
        return [(r[0], r[1], *rows[find(k)][:2], int(links[k])) for k, r in enumerate(rows) if links[k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = (None, 0, 0), []
        for batch in slices(batches):
            out = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                if row[:3] != at:
                    out += solve(*at[1:], held)
                    at, held = row[:3], []
                held.append(row[3:])
            if out:
                yield _rows(out)
        if out := solve(*at[1:], held):
            yield _rows(out)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["s1", "s2", "r1", "r2", "links"])

    keys = ["label", "i", "j"]
    ready = dealt.select(*keys, "s1", "s2", "block", "weight", "grams").repartition(*keys).sortWithinPartitions(*keys)
    return ready.mapInArrow(run, "s1 long, s2 long, r1 long, r2 long, links long")


def _with_sets(texts: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """nodes (d, e, ...) with the full set of one text each, as bytes. Sets, not texts, are shuffled, and those of texts
    that are no node are left out before, as far as a bitmap of bounded size can tell."""
    flags = texts.sparkSession.sparkContext.broadcast(bitmap(nodes, "d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in slices(batches):
            ids, grams = [], []
            for i in np.flatnonzero(flagged(flags.value, batch.column(0).to_numpy())).tolist():
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key in seen:  # a copy in the same task has the same set
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                ids.append(key)
                grams.append(shingles(batch.column(2)[i].as_py(), n).tobytes())
            if ids:
                d, e = zip(*ids, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(e, pa.int64()), pa.array(grams, pa.binary())], names=["d", "e", "grams"])

    sets = texts.select("d", "e", "text").mapInArrow(run, "d long, e long, grams binary")
    return sets.join(nodes, ["d", "e"]).drop("d", "e")


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, (d, e) of its text, class_id, n_links (other documents at the threshold, copies
    included), n_copies (documents with the same windows, itself included), stays (whether it stands for its class)."""
    bands = bands_for(threshold, recall, ROWS)
    texts = keyed(docs)
    told = settle(_described(texts, n, bands, ROWS), "jaccard-texts")
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d", "e")  # the row that stays for a class: its least id
    sets = settle(told.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("weight"), F.min(head).alias("head"), F.first("n").alias("n")), "jaccard-sets")
    # the shuffle on band hashes: a star from every band's nodes to the least of them
    banded = told.where("bands is not null").select("s1", F.explode("bands").alias("band")).distinct()
    least = banded.groupBy("band").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("band", "lo")
    edges = banded.join(least, "band").where("s1 <> lo").select(F.col("s1").alias("a"), F.col("lo").alias("b"))
    labels = settle(components(edges), "jaccard-groups")
    at = told.where("bands is not null").groupBy("s1", "s2").agg(F.min(F.struct("d", "e")).alias("t"))
    nodes = sets.join(labels, sets.s1 == labels.node).join(at, ["s1", "s2"]).select("s1", "s2", "weight", "n", "label", F.col("t.d").alias("d"), F.col("t.e").alias("e"))
    nodes = settle(nodes, "jaccard-nodes")
    sizes = nodes.groupBy("label").agg(F.sum("n").alias("windows")).select("label", F.ceil(F.col("windows") / block).cast("int").alias("blocks"))
    placed = nodes.join(sizes, "label").withColumn("block", F.pmod(F.hash("s1", "s2"), F.col("blocks")))
    grams = _with_sets(texts, placed, n)
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = grams.withColumn("p", F.explode(others)).select("label", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "s1", "s2", "block", "weight", "grams")
    found = settle(_verified(dealt, threshold), "jaccard-links")
    links = found.groupBy("s1", "s2").agg(F.sum("links").alias("links"), F.min(F.struct("r1", "r2")).alias("r"))
    # a group in one task is told apart there; one in several is put together by its roots
    spread = found.join(placed.where("blocks > 1").select("s1", "s2"), ["s1", "s2"]).select(F.col("s1").alias("a"), F.col("r1").alias("b"))
    joined = components(spread).select(F.col("node").alias("s1"), F.col("label").alias("whole"))
    key = links.join(joined, "s1", "left")
    key = key.select("s1", "s2", "links", F.coalesce("whole", "r.r1").alias("k1"), F.when(F.col("whole").isNull(), F.col("r.r2")).otherwise(0).alias("k2"), F.col("whole").isNotNull().alias("k3"))
    own = sets.join(key, ["s1", "s2"], "left").select("s1", "s2", "weight", "head", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("k1", "s1").alias("k1"), F.coalesce("k2", "s2").alias("k2"), F.coalesce("k3", F.lit(False)).alias("k3"))
    own = settle(own, "jaccard-classes")
    heads = own.groupBy("k1", "k2", "k3").agg(F.min("head").alias("head"))
    per_set = own.drop("head").join(heads, ["k1", "k2", "k3"]).select("s1", "s2", "head", F.when(F.col("n") > 0, F.col("links") + F.col("weight") - 1).otherwise(0).alias("n_links"), F.col("weight").alias("n_copies"))
    mine = (F.col("d") == F.col("head.d")) & (F.col("e") == F.col("head.e")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id"))
    rows = told.select("doc_id", "d", "e", "s1", "s2").join(per_set, ["s1", "s2"])
    return rows.select("doc_id", "d", "e", F.col("head.doc_id").alias("class_id"), "n_links", "n_copies", mine.alias("stays"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, the one of the least doc_id."""
    stay = classes(docs).where("stays").select(F.col("doc_id").alias("_id"), F.col("d").alias("_d"), F.col("e").alias("_e")).distinct()
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest")  # whatever their names are
    rows = keyed(docs.select("doc_id", rest, F.col("text").isNull().alias("_null"), "text"), ("doc_id", "_rest", "_null"))
    same = (F.col("d") == F.col("_d")) & (F.col("e") == F.col("_e")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    kept = rows.join(stay, same).dropDuplicates(["d", "e", "_id"])
    return kept.select(*[F.when(~F.col("_null"), F.col("text")).alias("text") if c == "text" else F.col(f"_rest.`{c}`") for c in docs.columns])
