"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised, ended with a separator id and cut at multiples of the window; what remains of each is packed in
blocks of bounded size. In a block of k windows every remainder starts as a partial partition of its own (one filled
slot, k - 1 empty ones). The two partial partitions with the largest imbalance are merged, fullest slots of one on
emptiest slots of the other, until one partition is left, whose slots are near-equal windows. If a window exceeds the
capacity, k rises and the block is packed again.

Defined cases: a null or empty text is the separator alone; equal rows are packed each on their own; a long text is
tokenised piece by piece, cut at white space, and its ids are the same as of the whole; other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ALPHABET, Numbers, shown
from .common import settle, slices

WINDOW = 4096
SEPARATOR = 2
BLOCK = 1000  # pieces packed together, about
CHUNK = 1_000_000  # characters tokenised at a time
KNOWN_WORDS = 600_000  # words a worker remembers, and those of one more call
# Fixed value: what Unicode calls white space
WORD = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
# Fixed value: characters that keep their form under the tokenizer's normaliser but for case, in one byte of Latin-1 each
SIMPLE = re.compile("[\\t\\n\\r -~\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff]*")
BLANKS = b"\t\n\r "
LETTER, DIGIT, BLANK, SIGN = range(4)
# kinds of the lower-case characters of SIMPLE
KINDS = bytes(BLANK if c in BLANKS else DIGIT if chr(c) in "0123456789" else LETTER if chr(c).isalpha() else SIGN for c in range(256))

_WORKERS: dict[str, "WordIds"] = {}


def run_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of lower-case SIMPLE text begin and end, the way the tokenizer cuts: runs of letters or signs, single digits,
    's 't 'm 'd 're 've 'll. The text is Latin-1 and ends with three blanks at least."""
    raw, kind = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(KINDS), np.uint8)
    begin = np.ones(len(raw), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    quote = np.flatnonzero(begin & (raw == ord("'")))
    after, third = raw[quote + 1], raw[quote + 2]
    short = quote[np.isin(after, list(b"stmd"))]
    long = quote[(((after == ord("r")) | (after == ord("v"))) & (third == ord("e"))) | ((after == ord("l")) & (third == ord("l")))]
    begin[short + 1] = begin[long + 1] = False
    begin[short + 2] = begin[long + 3] = True
    at = np.flatnonzero(begin)
    solid = kind[at] != BLANK
    return at[solid], np.append(at[1:], len(raw))[solid]


class WordIds:
    """Ids of texts by way of remembered words.

    The tokenizer never joins across white space, so a text is the sum of its words. Texts of plain letters, digits and
    punctuation (SIMPLE) are cut on, the way the tokenizer does, into runs of one kind, of which there are fewer: all at once with
    array operations, equal runs folded by Arrow. Runs are remembered as bytes, words as text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the model alone, for runs: what stands before it, the normaliser and the cut, is done
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        end, vocabulary = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        if not end or not all(c in vocabulary and c + end in vocabulary for c in ALPHABET):
            raise ValueError(f"{path}: ids do not show where a word ends")
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith(end)]] = True
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.used = 0  # ids in flat
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str | bytes]) -> None:
        """Ids of the words numbered last."""
        runs, rest = [], []
        for i, w in enumerate(words):
            (runs if isinstance(w, bytes) else rest).append(i)
        # many runs in one call, a blank between them
        parts = [[words[i].decode("latin-1").encode() for i in runs[a : a + 500]] for a in range(0, len(runs), 500)]
        some = self.model.encode_batch_fast([shown(part) for part in parts], add_special_tokens=False)
        ids = [np.array(e.ids, np.uint32) for e in some]
        sizes = [np.diff(np.flatnonzero(self.closes[x]) + 1, prepend=0) for x in ids]
        for e in self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False) if rest else []:
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.array([len(e.ids)]))
        size = np.concatenate(sizes)
        order = np.array(runs + rest, np.int64)
        first, last = len(self.known) - len(words), len(self.known)
        got = np.concatenate(ids)
        self.start, self.size = _room(self.start, last), _room(self.size, last)
        self.flat = _room(self.flat, self.used + len(got))
        self.start[first + order] = self.used + np.cumsum(size) - size
        self.size[first + order] = size
        self.flat[self.used : self.used + len(got)] = got
        self.used += len(got)

    def _numbers(self, words: list[str] | list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the runs of SIMPLE texts, and how many each text has."""
        data = "\n".join([*texts, "\n\n"]).lower().encode("latin-1")
        at, stop = run_bounds(data)
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(stop - at, out=ends[1:])
        folded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data.translate(None, BLANKS))]).dictionary_encode()
        upto = np.searchsorted(at, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
        return self._numbers(folded.dictionary.to_numpy(zero_copy_only=False).tolist())[folded.indices.to_numpy()], np.diff(upto, prepend=0)

    def _ids(self, index: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
        """Ids of texts of ``count`` words each, from the numbers of all their words."""
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        if not len(index):
            return [np.zeros(0, np.uint32)] * len(count)
        size = self.size[index]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[index] - (ends - size), size) + np.arange(int(ends[-1]))]
        last = np.cumsum(count)
        stops = np.where(last > 0, ends[np.maximum(last - 1, 0)], 0)
        return np.split(ids, stops[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        simple = [SIMPLE.fullmatch(t) is not None and "<|" not in t for t in texts]
        runs = iter(self._ids(*self._runs([t for t, s in zip(texts, simple, strict=True) if s])) if any(simple) else [])
        found = [WORD.findall(t) for t, s in zip(texts, simple, strict=True) if not s]
        words = iter(self._ids(self._numbers(list(chain.from_iterable(found))), np.fromiter(map(len, found), np.int64, len(found))))
        return [next(runs if s else words) for s in simple]


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy of at least twice its length, with room for n numbers."""
    if n <= len(array):
        return array
    more = np.zeros(max(n, 2 * len(array)), array.dtype)
    more[: len(array)] = array
    return more


def _segments(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > CHUNK:
        cut = next((m.start() for m in re.finditer(r"[ \n]", text[at + CHUNK : at + 2 * CHUNK])), None)
        if cut is None:
            found = re.compile(r"[ \n]").search(text, at + CHUNK)
            cut = (found.start() if found else len(text)) - at - CHUNK
        yield text[at : at + CHUNK + cut]
        at += CHUNK + cut
    yield text[at:]


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece: whole windows, then parts of a quarter window, whose sizes
    differencing balances well; the documents never leave their tasks."""
    part = max(1, window // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _WORKERS:
            _WORKERS[tokenizer] = WordIds(tokenizer)
        ids_of = _WORKERS[tokenizer]
        for batch in slices(batches):
            rows: list[tuple] = []
            todo: list[tuple[int, str]] = []
            size = 0
            parts: dict[int, list[np.ndarray]] = {}

            def flush() -> None:
                for (row, _), ids in zip(todo, ids_of.encode([s for _, s in todo]), strict=True):
                    parts.setdefault(row, []).append(ids)

            def close() -> None:
                for row, got in parts.items():
                    ids = np.concatenate([*got, np.array([SEPARATOR], np.uint32)]).astype("<u4")
                    doc_id, whole = batch.column(0)[row].as_py(), len(ids) - len(ids) % window
                    for a, b in [*((a, a + window) for a in range(0, whole, window)), *((a, min(a + part, len(ids))) for a in range(whole, len(ids), part))]:
                        rows.append((doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids)))
                parts.clear()

            for row, text in enumerate(batch.column(1)):
                for segment in _segments(text.as_py() or ""):
                    todo.append((row, segment))
                    size += len(segment)
                    if size >= CHUNK:
                        flush()
                        todo, size = [], 0
                if not todo:
                    close()
            flush()
            close()
            todo.clear()
            if rows:
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def differencing(lengths: list[int], k: int) -> list[tuple[int, list[int]]]:
    """(sum, items) of the filled slots among k, by largest differencing."""
    # a partial partition is its filled slots, fullest first; the other k - len slots are empty
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(lengths)]
    if k == 1:
        return [(sum(lengths), list(range(len(lengths))))]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        clash = max(0, len(a) + len(b) - k)  # emptiest filled slots of a get the emptiest filled slots of b, crosswise
        merged = a[: len(a) - clash] + b[: len(b) - clash]
        for x, y in zip(a[len(a) - clash :], reversed(b[len(b) - clash :]), strict=True):
            merged.append((x[0] + y[0], x[1] + y[1]))
        merged.sort(key=lambda s: -s[0])
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[0][0], tick, merged))
        tick += 1
    return heap[0][2]


def windows(lengths: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Items of each window; no window holds more than the capacity."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        slots = differencing(lengths, k)
        if max((s for s, _ in slots), default=0) <= capacity:
            return [items for _, items in slots]
        k += max(1, k // 200)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """The pieces with sequence_id and offset."""
    # the row number, stable once written, deals equal pieces to all blocks
    cut = settle(pieces(docs, tokenizer, window).withColumn("salt", F.monotonically_increasing_id()), "pack-pieces")
    blocks = max(1, -(-cut.count() // BLOCK))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(blocks))).drop("salt")

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sequence, offset = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        n = int(block["block"].iloc[0]) << 32
        step = 2 * BLOCK  # a block that rows equal in everything have filled is packed in parts
        for a in range(0, len(block), step):
            sizes = block["length"].iloc[a : a + step].tolist()
            full = sum(1 for s in sizes if s == window)  # longest first
            for i in range(full):
                sequence[a + i], n = n, n + 1
            for items in windows(sizes[full:], window) if len(sizes) > full else []:
                at = 0
                for i in items:
                    sequence[a + full + i], offset[a + full + i] = n, at
                    at += sizes[full + i]
                n += 1
        return block.drop(columns="block").assign(sequence_id=sequence, offset=offset)

    kind = dict(cut.dtypes)["doc_id"]
    return dealt.groupBy("block").applyInPandas(fill, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
