"""Repeated byte strings across and inside texts, from the intervals of an enhanced suffix array.

A string of ``least`` bytes that occurs twice holds the same anchor at the same place in both occurrences: the position
of the least hash of GRAM bytes in it. So only suffixes that start at anchors are sorted, and only where an anchor's hash
occurs twice. Spark groups anchors by hash (GRAM bytes and, as a second hash, all bytes within reach of the anchor);
equal surroundings are repeats as they stand. For anchors with different surroundings the bytes are fetched, one
surrounding each, and in every group the suffixes are sorted, neighbours' common prefixes are scanned with a stack into
prefix intervals, and in every interval the members are sorted again by what stands to the left: an interval whose
members differ there is a maximal repeat, and its occurrences are all members, not just neighbours.

Groups of over GROUP surroundings do not go to one task: their windows are counted by hash, spread over the cluster.

The same pass can tell two lengths of repeats apart: anchors are then set for the shorter one (``passage``), which any longer
repeat holds too, and each interval is measured against both.

Defined cases: a null text is empty; texts under ``least`` bytes have no repeats; equal texts are told by 128 bits of
hash, and a text with a copy is repeated whole; rows with equal or null ids are rows like others; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ddl, mix64, settle, slices, text_bytes

LEAST = 400
PASSAGE = 240  # bytes; prose of over 50 words is longer
SEGMENT = 1 << 18  # bytes of a text hashed at a time
GROUP = 100_000  # surroundings of one anchor sorted in one task
SEEN = 1_000_000  # texts a task remembers

_RANDOM = mix64(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _gram(least: int) -> int:
    return max(1, least // 4)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 4 * SEGMENT // 3)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            got = _POWERS[base] = (np.cumprod(up), np.cumprod(down))
    return got


class Rolling:
    """Hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray, which: int):
        self.up, self.down = _powers((0x5851F42D4C957F2D, 0xD1342543DE82EF95)[which] | 1, len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_RANDOM[256 * which : 256 * which + 256][data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every window."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors_of(data: np.ndarray, least: int, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash of GRAM bytes, hash of the surroundings) of the anchors of one text: the surroundings are what a string
    of ``least`` bytes around the anchor can reach."""
    k, n = _gram(passage), len(data)
    width, reach = passage - k + 1, least - k
    where, grams, around = [], [], []
    last = -1
    for a in range(0, n - passage + 1, SEGMENT):
        # windows that start in [a, b); bytes of their anchors' surroundings
        b = min(a + SEGMENT, n - passage + 1)
        lo, hi = max(0, a - reach), min(n, b + 2 * least)
        part = data[lo:hi]
        rolling = Rolling(part, 0)
        h = rolling.grams(k)[a - lo : b - lo + width - 1]
        low = _slide(h, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), width, np.maximum) == h)
        pos = at + a
        fresh = pos > last
        at, pos = at[fresh], pos[fresh]
        if not len(pos):
            continue
        last = int(pos[-1])
        start, stop = np.maximum(pos - reach, 0), np.minimum(pos + least, n)
        with np.errstate(over="ignore"):
            ctx = mix64(Rolling(part, 1).of(start - lo, stop - lo) + (pos - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        where.append(pos)
        grams.append(h[at])
        around.append(ctx)
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(where), np.concatenate(grams), np.concatenate(around)


def keyed(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, text and (d, e), 128 bits that tell texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, text.alias("text"), F.xxhash64(text).alias("d"), F.xxhash64(F.lit(7), text).alias("e"))


def _anchors(texts: DataFrame, least: int, passage: int) -> DataFrame:
    """h, ctx, d, e, pos of every anchor of a string of ``passage`` bytes. Anchors with equal surroundings in one batch are folded before any shuffle: each
    is marked ``twice``, and all but one of them ``spare``, as what they repeat is known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches):
            d, e = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, ends = text_bytes(batch.column(2))
            out = []
            size = 0
            for i in range(len(d)):
                key = (int(d[i]), int(e[i]))
                if ends[i + 1] - ends[i] < passage or key in seen:  # a copy in the same task has the same anchors
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                pos, h, ctx = anchors_of(data[ends[i] : ends[i + 1]], least, passage)
                out.append((h.view(np.int64), ctx.view(np.int64), np.full(len(pos), d[i]), np.full(len(pos), e[i]), pos.astype(np.int32)))
                size += len(pos)
                if size > 100_000:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        h, ctx, d, e, pos = (np.concatenate(c) for c in zip(*out, strict=True))
        by = np.lexsort((ctx, h))
        again = np.zeros(len(by), bool)
        again[1:] = (h[by][1:] == h[by][:-1]) & (ctx[by][1:] == ctx[by][:-1])
        twice = again.copy()
        twice[:-1] |= again[1:]
        return pa.RecordBatch.from_arrays([pa.array(x[by]) for x in (h, ctx, d, e, pos)] + [pa.array(twice), pa.array(again)], names=["h", "ctx", "d", "e", "pos", "twice", "spare"])

    return texts.where(F.octet_length("text") >= passage).select("d", "e", "text").mapInArrow(run, "h long, ctx long, d long, e long, pos int, twice boolean, spare boolean")


def _surroundings(texts: DataFrame, asked: DataFrame, least: int, passage: int) -> DataFrame:
    """(h, ctx, left, right) bytes around one occurrence of every asked anchor; left is reversed."""
    reach = least - _gram(passage)
    wanted = asked.groupBy("d", "e").agg(F.collect_list(F.struct("h", "ctx", "pos")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches):
            data, ends = text_bytes(batch.column(2))
            want = batch.column(3)
            lists = want.offsets.to_numpy() - want.offsets[0].as_py()
            h, ctx, pos = (x.to_numpy(zero_copy_only=False) for x in want.flatten().flatten())
            rows = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                text = data[ends[i] : ends[i + 1]]
                for j in range(lists[i], lists[i + 1]):
                    p = int(pos[j])
                    rows.append((h[j], ctx[j], text[max(0, p - reach) : p][::-1].tobytes(), text[p : p + least].tobytes()))
                    if len(rows) >= 5_000:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "ctx", "left", "right"])

    return texts.join(wanted, ["d", "e"]).select("d", "e", "text", "want").mapInArrow(run, "h long, ctx long, left binary, right binary")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def prefix_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, common prefix) of the prefix intervals of a suffix array, by stack scan. lcp[i]: of i and i + 1."""
    stack: list[tuple[int, int]] = []  # (first, common prefix), growing
    for i, value in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][1] > value:
            first, upto = stack.pop()
            yield first, i, upto
        if value >= least and (not stack or stack[-1][1] < value):
            stack.append((first, value))


def maximal_repeats(left: list[bytes], right: list[bytes], least: int, reach: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Maximal repeat groups around one anchor: (bytes to the right, number of members, [(member, bytes to the left)]), the
    members being all whose left side goes on equally with another's far enough to make ``least`` bytes."""
    for upto, size, members, far in _repeats(left, right, least, reach):
        yield upto, size, list(zip(members.tolist(), far.tolist(), strict=True))


def _repeats(left: list[bytes], right: list[bytes], least: int, reach: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The same with the members and their bytes to the left as arrays.

    Left sides are sorted once. In an interval its members are put in order of their left rank, and what neighbours share is
    the least of the shared lengths between their ranks, looked up in a table of minima over spans of 2**i ranks.
    """
    n = len(right)
    order = np.array(sorted(range(n), key=right.__getitem__), np.int64)
    lcp = [_common(right[a], right[b]) for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]
    by_left = sorted(range(n), key=left.__getitem__)
    minima = [np.array([_common(left[a], left[b]) for a, b in zip(by_left, by_left[1:], strict=False)], np.int64)]
    while len(minima[-1]) > 1 << (len(minima) - 1):
        span = 1 << (len(minima) - 1)
        minima.append(np.minimum(minima[-1][:-span], minima[-1][span:]))
    table = np.zeros((len(minima), n), np.int64)
    for i, row in enumerate(minima):
        table[i, : len(row)] = row
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    of_rank = np.array(by_left, np.int64)
    for first, last, upto in prefix_intervals(lcp, least - reach):
        at = np.sort(rank[order[first : last + 1]])
        level = np.frexp((at[1:] - at[:-1]).astype(np.float64))[1] - 1
        near = np.minimum(table[level, at[:-1]], table[level, at[1:] - (1 << level)])
        # left-diverse or not is what these lengths say: an end of text or another byte stops each of them
        far = np.zeros(len(at), np.int64)
        far[:-1] = near
        far[1:] = np.maximum(far[1:], near)
        found = far + upto >= least
        if found.any():
            yield upto, len(at), of_rank[at[found]], far[found]


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _sorted_groups(around: DataFrame, least: int, passage: int) -> DataFrame:
    """(h, ctx, a, b, long): bytes [pos + a, pos + b) of an anchor with these surroundings are in repeats of ``least`` bytes (long)
    or of ``passage`` bytes."""
    reach = passage - _gram(passage)

    def solve(ctx: list[int], left: list[bytes], right: list[bytes]) -> Iterator[tuple[int, int, int, bool]]:
        one = {c: i for i, c in enumerate(ctx)}  # a surrounding that came twice counts once
        if len(one) < 2:
            return
        keep = list(one.values())
        ctx, left, right = [ctx[i] for i in keep], [left[i] for i in keep], [right[i] for i in keep]
        if len(ctx) == 2:  # one interval
            far, upto = _common(*left), _common(*right)
            if upto >= passage - reach and far + upto >= passage:
                yield from ((c, -far, upto, far + upto >= least) for c in ctx)
            return
        # every repeat holds the anchor, so what those of one length cover together is one range
        back, ahead = np.full((2, len(ctx)), -1, np.int64), np.zeros((2, len(ctx)), np.int64)
        for upto, _, members, far in _repeats(left, right, passage, reach):
            for long, size in enumerate((passage, least)):
                hit = far + upto >= size
                back[long, members[hit]] = np.maximum(back[long, members[hit]], far[hit])
                ahead[long, members[hit]] = np.maximum(ahead[long, members[hit]], upto)
        more = (back[0] != back[1]) | (ahead[0] != ahead[1])
        for long, which in ((1, back[1] >= 0), (0, more & (back[0] >= 0))):
            for m in np.flatnonzero(which).tolist():
                yield ctx[m], -int(back[long, m]), int(ahead[long, m]), bool(long)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [])
        for batch in slices(batches):
            out = []
            for h, c, x, y in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if h != at:
                    out += [(at, *r) for r in solve(*held)]
                    at, held = h, ([], [], [])
                held[0].append(c)
                held[1].append(x)
                held[2].append(y)
            if out:
                yield _rows(out)
        if out := [(at, *r) for r in solve(*held)]:
            yield _rows(out)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "ctx", "a", "b", "long"])

    return around.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, ctx long, a int, b int, long boolean")


def _counted_groups(around: DataFrame, least: int, passage: int) -> DataFrame:
    """The same for anchors with very many surroundings: each window is counted by 128 bits of hash."""
    found = _counted(around, least, least - _gram(passage)).withColumn("long", F.lit(True))
    return found if passage == least else found.unionByName(_counted(around, passage, passage - _gram(passage)).withColumn("long", F.lit(False)))


def _counted(around: DataFrame, least: int, reach: int) -> DataFrame:
    back = F.least(F.lit(reach), F.length("left"))
    steps = F.filter(F.sequence(F.lit(0), back), lambda x: x + F.length("right") >= least)
    rows = around.dropDuplicates(["h", "ctx"]).select("h", "ctx", "left", "right", F.explode(steps).alias("l"))
    window = [F.substring("left", F.lit(1), F.col("l")), F.substring("right", F.lit(1), F.lit(least) - F.col("l"))]
    rows = rows.select("h", "ctx", "l", F.xxhash64(*window).alias("w"), F.xxhash64(F.lit(7), *window).alias("v"))
    twice = rows.groupBy("h", "l", "w", "v").agg(F.min("ctx").alias("x"), F.max("ctx").alias("y")).where("x <> y").select("h", "l", "w", "v")
    hit = rows.join(twice, ["h", "l", "w", "v"])
    return hit.select("h", "ctx", (-F.col("l")).cast("int").alias("a"), (F.lit(least) - F.col("l")).cast("int").alias("b"))


def repeated_spans(texts: DataFrame, least: int = LEAST, passage: int | None = None) -> DataFrame:
    """(d, e, spans) of every text with a repeat: (start, stop, long) byte ranges that cover what is repeated in strings of
    ``least`` bytes (long) or of ``passage`` bytes (all; if None, as ``least``); they may overlap and pass the ends of the text (see
    merged()).

    ``texts``: rows of keyed(). Copies of a text count as one here; a text that has one is repeated whole, and its
    spans say so.
    """
    passage = passage or least
    reach = least - _gram(passage)
    anchors = settle(_anchors(texts, least, passage), "repeat-anchors")
    group, same, times = W.partitionBy("h"), W.partitionBy("h", "ctx"), F.when(F.col("twice"), 2).otherwise(1)
    hits = (
        anchors.where("not spare")
        .drop("spare")
        .repartition("h")
        .dropDuplicates()
        .select(
            "*",
            F.sum(times).over(group).alias("n"),
            (F.min("ctx").over(group) != F.max("ctx").over(group)).alias("differ"),
            F.sum(times).over(same).alias("n_same"),
            F.row_number().over(same.orderBy("d", "e", "pos")).alias("nth"),
        )
        .where("n > 1")
    )
    hits = settle(hits, "repeat-hits")
    asked = hits.where("differ and nth = 1").select("h", "ctx", "d", "e", "pos", F.count(F.lit(1)).over(group).alias("size"))
    asked = settle(asked, "repeat-asked")
    found = _sorted_groups(_surroundings(texts, asked.where(F.col("size") <= GROUP), least, passage), least, passage)
    if asked.where(F.col("size") > GROUP).limit(1).count():
        found = found.unionByName(_counted_groups(_surroundings(texts, asked.where(F.col("size") > GROUP), least, passage), least, passage))
    found = settle(found, "repeat-found")
    # surroundings that occur twice are covered as far as they go; the cut at a text's end is made with its length at hand
    known = hits.where("n_same > 1").select("d", "e", "pos").unionByName(anchors.where("spare").select("d", "e", "pos"))
    whole = known.select("d", "e", (F.col("pos") - reach).alias("start"), (F.col("pos") + least).alias("stop"), F.lit(True).alias("long"))
    partly = hits.where("n_same = 1 and differ").join(found, ["h", "ctx"]).select("d", "e", (F.col("pos") + F.col("a")).alias("start"), (F.col("pos") + F.col("b")).alias("stop"), "long")
    copies = texts.where(F.octet_length("text") >= passage).groupBy("d", "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = copies.select("d", "e", F.lit(0).alias("start"), F.lit(2**31 - 1).alias("stop"), F.lit(True).alias("long"))
    spans = whole.unionByName(partly).unionByName(copies).groupBy("d", "e").agg(F.collect_list(F.struct("start", "stop", "long")).alias("spans"))
    return spans


def merged(spans: list[dict] | None, size: int, least: int = 0) -> list[tuple[int, int]]:
    """Ranges that repeats of ``least`` bytes cover (the long spans; none in a shorter text), or if it is 0 all spans."""
    if size < least:
        return []
    return _covered([(max(0, s["start"]), min(size, s["stop"])) for s in spans or () if s["long"] or not least])


def deduplicate(docs: DataFrame, least: int = LEAST, passage: int = PASSAGE) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and n_passage: bytes in strings of ``passage`` bytes that also
    start elsewhere, which stay where they are in no longer repeat."""
    texts = keyed(docs)
    joined = texts.join(repeated_spans(texts, least, passage), ["d", "e"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, ends = text_bytes(batch.column(1))
            out = []
            for i, spans in enumerate(batch.column(2)):
                text = data[ends[i] : ends[i + 1]]
                found = spans.as_py() if spans.is_valid else None
                gone = merged(found, len(text), least)
                sha, at = hashlib.sha256(), 0
                for a, b in gone:
                    sha.update(text[at:a].tobytes())
                    at = b
                sha.update(text[at:].tobytes())
                out.append((len(text), sum(b - a for a, b in gone), len(gone), sha.hexdigest(), sum(b - a for a, b in merged(found, len(text)))))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=names)

    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long")


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` with their repeats cut out of ``text``, to the next whole character, and n_chars to match."""
    rest = F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("_rest")  # whatever their names are
    texts = keyed(docs.select(rest, "text"), ("_rest",))
    joined = texts.join(repeated_spans(texts, least), ["d", "e"], "left").select("_rest", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, ends = text_bytes(batch.column(1))
            out = []
            for i, spans in enumerate(batch.column(2)):
                text = data[ends[i] : ends[i + 1]]
                kept, at = [], 0
                for a, b in merged(spans.as_py() if spans.is_valid else None, len(text)):
                    kept.append(text[at:a].tobytes())
                    at = b
                kept.append(text[at:].tobytes())
                out.append("".join(part.decode("utf-8", "ignore") for part in kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["_rest", "text", "n_chars"])

    left = joined.mapInArrow(run, f"{ddl(joined.select('_rest'))}, text string, n_chars long")
    return left.select(*[F.col(c) if c in ("text", "n_chars") else F.col(f"_rest.`{c}`") for c in docs.columns])
