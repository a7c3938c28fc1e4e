"""The corpus pipeline on a planted fixture, each stage by plain Python on what the stage before has left."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from panelmill.llm import mixing, repeats
from panelmill.llm.q_packing import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the house garden with some flowers there were people walking along river under bridge while birds sang morning light".split(),
    "de": "das haus garten mit einigen blumen dort waren leute gingen entlang fluss unter bruecke waehrend voegel sangen morgen licht".split(),
}


def corpus():
    """(rows, ids of near copies, ids that share a passage): prose, near and exact copies, shared passages, texts without words."""
    r = random.Random(11)

    def prose(lang, n):
        return " ".join(r.choice(WORDS[lang]) + r.choice(["", "s", "er", "n", ","]) for _ in range(n))

    texts, near, shared = [], [], []
    for k in range(60):
        lang = "de" if k % 3 == 0 else "en"
        texts.append((prose(lang, r.randint(60, 160)), lang))
    for k in range(6):  # near copies of the first documents
        words = texts[k][0].split()
        words[3] = "changed"
        near.append((k, len(texts)))
        texts.append((" ".join(words), texts[k][1]))
    near.append((8, len(texts)))
    texts.append(texts[8])
    passage = prose("en", 55)
    for _ in range(3):
        shared.append(len(texts))
        texts.append((f"{prose('en', 120)} {passage} {prose('en', 120)}", "en"))
    texts += [("12345 67890 !!", None), ("", None), (None, None)]
    rows = [(i, t, lang, f"src{i % 4}", None) for i, (t, lang) in enumerate(texts)]
    return rows, near, shared, passage


@pytest.fixture(scope="module")
def run(spark):
    rows, near, shared, passage = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, "unused"), f"test-{name.replace(' ', '-')}")
        kept.append(docs)
    return {"rows": rows, "near": near, "shared": shared, "passage": passage, "tables": kept}


def test_order_and_columns(run):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "mixing sources", "packing"]
    for table in run["tables"][:-1]:
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language(run):
    """What has no letter or no text goes, all prose stays as it is."""
    left = {r["doc_id"]: tuple(r) for r in run["tables"][0].collect()}
    assert left == {r[0]: r for r in run["rows"] if re.search("[a-z]", r[1] or "")}


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates(run):
    before = {r["doc_id"]: r["text"] for r in run["tables"][0].collect()}
    sets = {i: shingles(t) for i, t in before.items()}
    root = {i: i for i in before}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in before:
        for j in before:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = {r["doc_id"] for r in run["tables"][1].collect()}
    assert left == {i for i in before if find(i) == i}
    assert left.isdisjoint({b for _, b in run["near"]}) and {a for a, _ in run["near"]} <= left


def test_repeated_strings(run):
    before = {r["doc_id"]: r["text"].encode() for r in run["tables"][1].collect()}
    least = repeats.PASSAGE
    seen = collections.Counter(t[i : i + least] for t in before.values() for i in range(len(t) - least + 1))
    after = {r["doc_id"]: r for r in run["tables"][2].collect()}
    assert after.keys() == before.keys()
    for i, t in before.items():
        gone = bytearray(len(t))
        for s in range(len(t) - least + 1):
            if seen[t[s : s + least]] > 1:
                gone[s : s + least] = b"\x01" * least
        want = bytes(c for c, g in zip(t, gone, strict=True) if not g).decode()
        assert after[i]["text"] == want and after[i]["n_chars"] == len(want), i
    assert all(run["passage"] not in after[i]["text"] for i in run["shared"])
    assert sum(after[i]["text"].encode() != t for i, t in before.items()) == len(run["shared"])


def test_mixture(run):
    """Rows as often as op7 takes them; every source within a document of its target."""
    before = run["tables"][2]
    plan = {r["doc_id"]: r for r in mixing.mix(before).collect()}
    times = collections.Counter(r["doc_id"] for r in run["tables"][3].collect())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in run["tables"][3].collect())
    for i, r in plan.items():
        assert times[i] * r["size"] == r["taken"]
    for s in {r["source"] for r in plan.values()}:
        mine = [r for r in plan.values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts.values())
    assert sum(r["target"] for r in {r["source"]: r for r in plan.values()}.values()) == pytest.approx(total)


def test_packs(run):
    """Every id of every row in one piece, sequences without gaps and not longer than a window."""
    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    want = collections.Counter()
    ids = {}
    for r in run["tables"][3].collect():
        ids[r["doc_id"]] = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        want[r["doc_id"]] += 1
    pieces = run["tables"][4].collect()
    got = collections.Counter()
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        got[p["doc_id"], p["start"], p["length"]] += 1
    covered = collections.Counter()
    for (i, start, n), k in got.items():
        for at in range(start, start + n):
            covered[i, at] += k
    assert covered == collections.Counter({(i, at): k for i, k in want.items() for at in range(len(ids[i]))})
    by = collections.defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, "unused"), "test-none")
    assert docs.count() == 0
