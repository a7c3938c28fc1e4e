"""Language identification of mixed-language text.

Model: for every language, smoothed log probabilities of hashed character trigrams, counted over all training documents
(each task counts its own rows into a fixed table; Spark adds the tables), and the share of letters by script. A word's
score in a language is the sum over its trigrams. Script ranges leave only languages that use the word's script. Viterbi
over the words, with a fixed cost for every change of language, labels spans; the document's language is the one that
covers most letters.

Defined cases: a null text or one without a letter is ``und`` with score 0 and no spans; equal evidence goes to the
language that comes first by name; an untrained model labels everything ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, mix64, slices

BUCKETS = 1 << 15  # of hashed trigrams, per language: bounds the model
SWITCH = 12.0  # cost of a change of language, in nats
PIECE = 1 << 20  # code points handled at a time
# First code point of each script range and its script
RANGES = [
    (0x0000, "common"), (0x0041, "latin"), (0x005B, "common"), (0x0061, "latin"), (0x007B, "common"), (0x00AA, "latin"),
    (0x00AB, "common"), (0x00BA, "latin"), (0x00BB, "common"), (0x00C0, "latin"), (0x0250, "latin"), (0x02B0, "common"),
    (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "common"), (0x2C00, "other"),
    (0x2E80, "han"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"),
    (0x3200, "common"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({name for _, name in RANGES})

_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, its lower case, its script. Built once per worker."""
    if not _TABLES:
        size = 0x110000
        letter, lower = np.zeros(size, bool), np.arange(size, dtype=np.uint32)
        for cp in range(0x32000):
            c = chr(cp)
            if c.isalpha():
                letter[cp] = True
                low = c.lower()
                if len(low) == 1:
                    lower[cp] = ord(low)
        script = np.zeros(size, np.uint8)
        ends = [a for a, _ in RANGES[1:]] + [size]
        for (start, name), end in zip(RANGES, ends, strict=True):
            script[start:end] = SCRIPTS.index(name)
        _TABLES.update(letter=letter, lower=lower, script=script)
    return _TABLES["letter"], _TABLES["lower"], _TABLES["script"]


def _pieces(text: str) -> Iterator[str]:
    """A text whole, or cut at white space into pieces of bounded size."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(" ", at, at + PIECE), text.rfind("\n", at, at + PIECE))
        cut = cut + 1 if cut > at else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


def _grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket of every letter, start of each word among the letters, letters and script of each word.

    Words are runs of letters; a trigram is a letter with its neighbours, where a word's edge counts as a blank.
    """
    letter, lower, script = _tables()
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cps = np.where(cps < 0x110000, cps, 0)
    at = np.flatnonzero(letter[cps])
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    low = lower[cps[at]].astype(np.uint64)
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) > 1
    last = np.ones(len(at), bool)
    last[:-1] = first[1:]
    before, after = np.roll(low, 1), np.roll(low, -1)
    before[first] = 32
    after[last] = 32
    with np.errstate(over="ignore"):
        key = mix64((before << np.uint64(42)) | (low << np.uint64(21)) | after)
    start = np.flatnonzero(first)
    return (key % np.uint64(BUCKETS)).astype(np.int64), start, np.diff(np.append(start, len(at))), script[cps[at[start]]].astype(np.int64)


def train(docs: DataFrame) -> dict:
    """Counts over every row of ``docs`` (text, lang) with a language: {langs, logp[lang, bucket], scripts[lang, script]}.

    The answer is languages x (BUCKETS + scripts) numbers, whatever the size of the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = seen.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                for piece in _pieces(text):
                    grams, _, letters, script = _grams(piece)
                    if len(grams):
                        table[:BUCKETS] += np.bincount(grams, minlength=BUCKETS)
                        table[BUCKETS:] += np.bincount(script, letters, minlength=len(SCRIPTS)).astype(np.int64)
        for lang, table in seen.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(table[at])], names=["lang", "bucket", "n"])

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toPandas()  # languages x BUCKETS at most
    langs = sorted(got["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    table[[langs.index(x) for x in got["lang"]], got["bucket"].to_numpy()] = got["n"].to_numpy()
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    logp = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS))
    share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    return {"langs": langs, "logp": logp.astype(np.float32), "scripts": share > 0.01}


def _viterbi(scores: np.ndarray) -> np.ndarray:
    """Best language of every word when each change costs SWITCH. scores: words x languages."""
    n, k = scores.shape
    best = int(scores.sum(0).argmax())
    # leaving `best` for some words gains at most the largest run of gains; under the cost of a switch it never pays
    gain = np.concatenate([[0.0], np.cumsum((scores - scores[:, [best]]).max(1, where=np.arange(k) != best, initial=-1e30))]) if k > 1 else np.zeros(1)
    if k == 1 or float((gain - np.minimum.accumulate(gain)).max()) <= SWITCH:
        return np.full(n, best)
    path, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(range(k), key=path.__getitem__)
        floor = path[top] - SWITCH
        stay = [p >= floor for p in path]
        back.append([i if s else top for i, s in enumerate(stay)])
        path = [(p if s else floor) + x for p, s, x in zip(path, stay, row, strict=True)]
    out = [max(range(k), key=path.__getitem__)]
    for step in reversed(back):
        out.append(step[out[-1]])
    return np.array(out[::-1])


def label(text: str | None, model: dict) -> tuple[str, float, list[tuple[int, int, str]]]:
    """Language, score and spans (first word, word after the last, language) of one text."""
    langs, logp, allowed = model["langs"], model["logp"], model["scripts"]
    parts = [g for g in (_grams(p) for p in _pieces(text or "")) if len(g[0])]
    if not parts or not langs:
        return "und", 0.0, []
    words, letters = [], []
    for grams, start, length, script in parts:
        by_lang = np.stack([np.add.reduceat(row[grams], start, dtype=np.float64) for row in logp], axis=1)
        fits = allowed[:, script].T
        fits[~fits.any(1)] = True  # a script of no language: all stay
        words.append(np.where(fits, by_lang, by_lang.min(1, keepdims=True) - 20.0 * length[:, None]))
        letters.append(length)
    scores, size = np.concatenate(words), np.concatenate(letters)
    path = _viterbi(scores)
    share = np.bincount(path, size, minlength=len(langs))
    pick = int(share.argmax())
    mine = scores[path == pick].sum(0)
    with np.errstate(over="ignore", under="ignore"):
        sure = 1.0 / np.exp(np.clip(mine - mine[pick], -700, 50)).sum()
    edge = np.flatnonzero(np.diff(path)) + 1
    starts, ends = np.append(0, edge), np.append(edge, len(path))
    spans = [(int(a), int(b), langs[path[a]]) for a, b in zip(starts, ends, strict=True)]
    return langs[pick], float(share[pick] / size.sum() * sure), spans


def identify(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns (``text`` may be one) plus lang_pred, lang_score and spans of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded: languages x BUCKETS numbers
    names = list(keep)
    read = names if "text" in names else [*names, "text"]
    schema = ddl(docs.select(*names)) + ", lang_pred string, lang_score double, spans array<struct<first:int,stop:int,lang:string>>"
    span = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [label(t.as_py(), shared.value) for t in batch.column(read.index("text"))]
            cols = [batch.column(i) for i in range(len(names))]
            cols += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            cols.append(pa.array([[dict(first=a, stop=b, lang=x) for a, b, x in f[2]] for f in found], span))
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "lang_score", "spans"])

    return docs.select(*read).mapInArrow(run, schema)
