"""Ids of a byte-level BPE tokenizer, by way of remembered words.

The tokenizer cuts a text into words (letters, digits or signs with at most one blank ahead, white space, contractions) and
never joins across them. So a batch of texts is cut at once with array operations, equal words are folded by Arrow, and
only words not met before go to the tokenizers library. Texts with characters beyond the table of kinds, or with the
string of a special token, go to the library as they are.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1_000_000  # characters cut at a time
KNOWN_WORDS = 1_000_000  # words a worker remembers, and those of one more call
LETTER, NUMBER, BLANK, SIGN, BEYOND = range(5)
SAFE = re.compile("[A-Za-z](?=[ \\n])")  # no word goes on behind such a letter
# White space of Unicode below U+2070, and the blocks whose characters have had one kind in all its versions
SPACES = {*range(9, 14), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}
BLOCKS = (range(0x250), range(0x2000, 0x2070))


def _kinds() -> np.ndarray:
    table = np.full(0x2071, BEYOND, np.uint8)
    for c in (c for block in BLOCKS for c in block):
        major = unicodedata.category(chr(c))[0]
        table[c] = BLANK if c in SPACES else LETTER if major == "L" else NUMBER if major == "N" else SIGN
    return table


KIND = _kinds()
# how a byte-level model writes bytes: printable ones as they are, the others from U+0100 on
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SHOWN = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
ALPHABET = [chr(SHOWN.get(b, b)) for b in range(256)]
GAP, MARK = b"\xff", b"\xfe"  # bytes that UTF-8 has no use for


def shown(words: list[bytes], between: bytes = GAP) -> str:
    """Words of UTF-8 as a byte-level model writes them, in one text; a GAP is a blank."""
    table = np.array([ord(c) for c in ALPHABET], np.uint32)
    table[GAP[0]] = ord(" ")
    return table[np.frombuffer(between.join(words), np.uint8)].tobytes().decode("utf-32-le")


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Parts of about ``size`` characters, cut where no word crosses; a text without such a place stays whole."""
    at = 0
    while len(text) - at > size and (found := SAFE.search(text, at + size)):
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def _codes(data: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points and their kinds; those of Latin-1 in one byte each."""
    try:
        latin = data.encode("latin-1")
    except UnicodeEncodeError:
        codes = np.frombuffer(data.encode("utf-32-le"), np.uint32)
        return codes, KIND[np.minimum(codes, len(KIND) - 1)]
    return np.frombuffer(latin, np.uint8), np.frombuffer(latin.translate(KIND[:256].tobytes()), np.uint8)


def word_starts(codes: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the words of some texts begin. ``codes``: code points of all texts; ``first``: True at the start of each text."""
    n = len(codes)
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    goes_on = np.zeros(n, bool)  # the next character is of the same text
    goes_on[:-1] = ~first[1:]
    # the last blank before a word stands alone, or belongs to the word if it is a space
    last = np.flatnonzero((kind[:-1] == BLANK) & goes_on[:-1] & (kind[1:] != BLANK))
    begin[last] = True
    begin[last[codes[last] == 0x20] + 1] = False
    # 's 't 'm 'd 're 've 'll where a word would begin
    quote = np.flatnonzero((codes == 0x27) & begin & goes_on)
    after = codes[quote + 1]
    short = quote[np.isin(after, [ord(c) for c in "stmd"])]
    third = np.where(goes_on[quote + 1], codes[np.minimum(quote + 2, n - 1)], 0)
    long = quote[((third == ord("e")) & ((after == ord("r")) | (after == ord("v")))) | ((third == ord("l")) & (after == ord("l")))]
    begin[short + 1] = begin[long + 1] = False
    ends = np.concatenate([short + 2, long + 3])
    begin[ends[ends < n]] = True
    return np.flatnonzero(begin)


class Numbers(dict):
    """Numbers words in the order they first come; ``new`` holds those numbered since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word: str | bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class ByteWords:
    """The ids of texts; ``path`` is a file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.by_word = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.tokenizer = Tokenizer.from_file(path)
        # the model alone: what stands before it in the library, the cut into words, is done
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.mark = self.tokenizer.token_to_id(ALPHABET[MARK[0]])  # the id between words; no text has it
        vocabulary = self.tokenizer.get_vocab()
        self.by_word = self.by_word and all(c in vocabulary for c in ALPHABET)
        self.size = self.tokenizer.get_vocab_size()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith(ALPHABET[0x20])]] = True
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.ids, self.begin, self.count = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """A number for each of some different words; new ones are tokenised, many in one call."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        return numbers

    def _learn(self, words: list[bytes]) -> None:
        """Ids of the words numbered last. An id that begins with a space begins a word whose only space is its first byte; between
        other words stands a mark."""
        spaced, rest = [], []
        for i, w in enumerate(words):
            (rest if w.rfind(b" ") else spaced).append(i)
        got = self._merged([words[i] for i in spaced], GAP)
        sizes = [np.diff(np.flatnonzero(self.opens[got]), append=len(got))]
        marked = self._merged([words[i] for i in rest], GAP + MARK + GAP)
        marks = np.flatnonzero(marked == self.mark)
        sizes.append(np.diff(marks - np.arange(len(marks)), prepend=0))
        size, order = np.concatenate(sizes), np.array(spaced + rest, np.int64)
        begin, count = np.zeros((2, len(words)), np.int64)
        begin[order], count[order] = len(self.ids) + np.cumsum(size) - size, size
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, got.astype(self.dtype), np.delete(marked, marks).astype(self.dtype)])

    def _merged(self, words: list[bytes], between: bytes) -> np.ndarray:
        """The ids of many words in a few calls, ``between`` after each."""
        texts = [shown([*words[a : a + 500], b""], between) for a in range(0, len(words), 500)]
        ids = [np.array(e.ids, np.int64) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int64), *ids])

    def _whole(self, text: str) -> np.ndarray:
        got = [self.tokenizer.encode(part, add_special_tokens=False).ids for part in segments(text)]
        return np.concatenate([np.array(ids, self.dtype) for ids in got])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them without special tokens added. At best of SEGMENT characters together."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = "".join(texts)
        codes, kind = _codes(data)
        starts = np.cumsum(sizes) - sizes
        odd = np.zeros(len(texts), bool)
        beyond = np.flatnonzero(kind == BEYOND)
        odd[np.searchsorted(starts + sizes, beyond, side="right")] = True
        if any(s in data for s in self.special):
            odd |= np.array([any(s in t for s in self.special) for t in texts])
        if not self.by_word:
            odd[:] = True
        out = [np.zeros(0, self.dtype)] * len(texts)
        for i in np.flatnonzero(odd):
            out[i] = self._whole(texts[i])
        plain = np.flatnonzero(~odd & (sizes > 0))
        if not len(plain):
            return out
        if odd.any():
            data = "".join([texts[i] for i in plain])
            keep = np.repeat(~odd, sizes)
            codes, kind = codes[keep], kind[keep]
            starts = np.cumsum(sizes[plain]) - sizes[plain]
        else:
            starts = starts[plain]
        first = np.zeros(len(codes), bool)
        first[starts] = True
        at = word_starts(codes, kind, first)
        width = np.ones(len(codes), np.int64) + (codes >= 0x80) + (codes >= 0x800)
        upto = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(width, out=upto[1:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(upto[at], upto[-1])), pa.py_buffer(data.encode())])
        folded = words.dictionary_encode()
        number = self._numbers(folded.dictionary.to_numpy(zero_copy_only=False).tolist())[folded.indices.to_numpy()]
        begin, count = self.begin[number], self.count[number]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]))]
        cuts = ends[np.searchsorted(at, starts[1:]) - 1]
        for i, got in zip(plain, np.split(ids, cuts), strict=True):
            out[i] = got
        return out
