"""Token files: words and code lengths against plain versions, exact round trips, odd tables."""

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelmill.llm import tokenfile
from panelmill.llm.bytebpe import ByteWords, segments
from panelmill.llm.huffman import Code, code_lengths
from panelmill.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, start double, file int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    return ByteWords(PATH)


PARTS = [*"aab \n\t'stmdrvelL.1,<|é «²“—ß\x1c\x85\xa0", "  ", "'s", "'re", "'ll", "'ve", " '", "<|endoftext|>", "日本", "🙂", " "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), min_size=1, max_size=8))
def test_words_as_the_library(words, library, texts):
    got = words.encode(texts)
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_segments_do_not_change_ids(words, library):
    r = random.Random(3)
    for text in ("".join(r.choice(PARTS[:30]) for _ in range(3000)), "x" * 3000, "", "a " * 2000, "\n" * 500):
        parts = list(segments(text, 50))
        assert "".join(parts) == text
        ids = [i for p in parts for i in words.encode([p])[0].tolist()]
        assert ids == library.encode(text, add_special_tokens=False).ids


def huffman_bits(counts):
    """Bits of all ids under a plain Huffman code."""
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def best_limited(counts, longest):
    """Least sum of bits by trying all sorted length assignments (a handful of ids)."""
    from itertools import product

    used = sorted((int(c) for c in counts if c), reverse=True)
    return min(sum(c * n for c, n in zip(used, lengths)) for lengths in product(range(1, longest + 1), repeat=len(used)) if sum(2.0**-n for n in lengths) <= 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=2, max_size=200))
def test_code_lengths(counts):
    counts = np.array(counts, np.int64)
    lengths = code_lengths(counts, 18).astype(np.int64)
    assert ((lengths > 0) == (counts > 0)).all()
    if (counts > 0).sum() > 1:
        assert sum(2.0 ** -int(n) for n in lengths if n) == 1
        assert (lengths * counts).sum() == huffman_bits(counts)  # so short a list needs no limit


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=2, max_size=6))
def test_limited_code_lengths(counts):
    counts = np.array(counts, np.int64) ** 3
    lengths = code_lengths(counts, 3).astype(np.int64)
    assert lengths.max() <= 3
    assert (lengths * counts).sum() == best_limited(counts, 3)


def test_limit_and_its_error():
    counts = 2 ** np.arange(30, dtype=np.int64)
    lengths = code_lengths(counts, 8).astype(np.int64)
    assert lengths.max() == 8 and sum(2.0 ** -int(n) for n in lengths) <= 1
    with pytest.raises(ValueError):
        code_lengths(counts, 4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=700), st.sampled_from([1, 3, 128]))
def test_bits_round_trip(ids, stride):
    ids = np.array(ids, np.int64)
    code = Code(code_lengths(np.bincount(ids, minlength=41)))
    bits, steps = code.encode(ids, stride)
    assert code.decode(bits, steps, len(ids), stride).tolist() == ids.tolist()
    assert len(bits) == -(-int(code.lengths[ids].astype(int).sum()) // 8)


def test_canonical():
    code = Code(code_lengths(np.array([5, 0, 9, 1, 1, 20])))
    used = sorted((int(n), i) for i, n in enumerate(code.lengths) if n)
    want, last = 0, 0
    for n, i in used:
        want = (want << (n - last)) if last else 0
        assert int(code.codes[i]) == want
        want, last = want + 1, n
    with pytest.raises(ValueError):
        code.encode(np.array([1]))


def expected(rows, library):
    """(doc_id, start, n, crc, ids) by rows in order, one after the other."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    return out


TEXTS = [None, "", "   ", "one two", "one two", "it's 日本 ☃", "<|endoftext|>", "word " * 5000, "x" * 4000, "Ein süßer Satz.\n\n" * 30]


@pytest.mark.parametrize("sizes", [(1 << 23, 1 << 16), (3000, 500), (50, 1)])
def test_round_trip(spark, tmp_path, library, sizes):
    rows = [(i * 3 % 7 if i != 4 else None, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, "clash", 1.0, 2) for i, t in rows], SCHEMA).repartition(3)
    path = f"{tmp_path}/f"
    tokenfile.write(docs, path, PATH, file_ids=sizes[0], block_ids=sizes[1])
    got = tokenfile.read(spark, path).collect()
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got)
    ids = [-1 if r[1] is None else r[1] for r in got]
    assert ids == sorted(ids) == sorted(-1 if i is None else i for i, _ in rows)
    assert [r[0] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    plain = expected(rows, library)
    assert sorted((r[2], r[3], r[4]) for r in got) == sorted((r[2], r[3], r[4]) for r in plain)
    if sizes[0] == 50:
        assert spark.read.parquet(f"{path}/files").count() > 1


def test_equal_ids_are_dealt_to_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(7, f"text number {i} of many", "", 0.0, 0) for i in range(400)], SCHEMA)
    tokenfile.write(docs, f"{tmp_path}/f", PATH, file_ids=300)
    files = spark.read.parquet(f"{tmp_path}/f/files").collect()
    assert len(files) > 4 and max(f["n_ids"] for f in files) < 1200
    assert tokenfile.read(spark, f"{tmp_path}/f", ids=False).count() == 400


def test_text_ids_empty_table_and_one_kind_of_id(spark, tmp_path, library):
    none = spark.createDataFrame([], "doc_id string, text string")
    tokenfile.write(none, f"{tmp_path}/none", PATH)
    assert tokenfile.read(spark, f"{tmp_path}/none").count() == 0
    only = spark.createDataFrame([("b", ""), ("a", None)], "doc_id string, text string")
    tokenfile.write(only, f"{tmp_path}/only", PATH)
    got = tokenfile.read(spark, f"{tmp_path}/only").orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["ids"]) for r in got] == [("a", 0, [0]), ("b", 1, [0])]


def test_text_longer_than_a_segment(spark, tmp_path, library, monkeypatch):
    text = "Lange Texte werden geteilt, it's so. " * 30_000 + "日本 " * 2000
    docs = spark.createDataFrame([(1, text), (2, "kurz")], "doc_id long, text string")
    assert len(text) > tokenfile.SEGMENT
    tokenfile.write(docs, f"{tmp_path}/f", PATH)
    got = tokenfile.read(spark, f"{tmp_path}/f").orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got] == expected([(1, text), (2, "kurz")], library)


def test_query_by_brute_force(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = QUERIES["op11_token_files"](spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [r[:4] for r in expected([(d["doc_id"], d["text"]) for d in docs], library)]


def test_words_are_learned_in_few_calls(library):
    """New words go to the model many in one call, not one by one."""

    class Model:
        def tokenize(self, word):
            raise AssertionError(word)

    class Slow:
        model = Model()

    words = ByteWords(PATH)
    words.tokenizer = Slow()
    texts = ["The quick  brown\n\n fox's été, 12 «don't»\t  end ", " a b\xa0c", "  \n x"]
    assert [g.tolist() for g in words.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
