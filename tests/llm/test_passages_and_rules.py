"""Repeats on the given documents by brute force, shared passages by byte length, and the verdict of the quality rules."""

import collections
import hashlib
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from panelmill.llm import htmltext, mixing, ordermin, repeats, rulefit, weakrules
from panelmill.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string"


def covered(texts, least):
    """Per text, which bytes lie in a string of ``least`` bytes that starts anywhere else too."""
    seen = collections.Counter(hash(t[s : s + least]) for t in texts for s in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone, reach = bytearray(len(t)), 0
        for s in range(len(t) - least + 1):
            if seen[hash(t[s : s + least])] > 1:
                gone[max(s, reach) : s + least] = b"\x01" * (s + least - max(s, reach))
                reach = s + least
        out.append(gone)
    return out


def test_whole_table(spark):
    """All documents of the 1,000-row table."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    texts = [(d["text"] or "").encode() for d in docs]
    got = QUERIES["op1_repeat_dedup"](spark, sf).orderBy("doc_id").collect()
    for g, t, long, short in zip(got, texts, covered(texts, repeats.LEAST), covered(texts, repeats.PASSAGE), strict=True):
        kept = bytes(c for c, x in zip(t, long, strict=True) if not x)
        runs = sum(1 for i, x in enumerate(long) if x and not (i and long[i - 1]))
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (len(t), sum(long), runs, hashlib.sha256(kept).hexdigest())
        assert g["n_passage"] == sum(short)


@pytest.mark.parametrize("n_words", [51, 60, 90])
def test_planted_passages(spark, n_words):
    """A passage of over 50 words in two otherwise different documents is found whatever its bytes; single ones are not."""
    r = random.Random(n_words)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n_words) for _ in range(15)]
    texts = [f"{prose(120)} {p} {prose(90)}" for p in passages for _ in range(2)] + [prose(300) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, None, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = repeats.deduplicate(docs).orderBy("doc_id").collect()
    for i, g in enumerate(got):
        size = len(passages[i // 2]) if i < 30 else 0
        assert g["n_passage"] >= size if size else g["n_passage"] == 0
        assert (g["n_removed"] > 0) == (size + 2 >= repeats.LEAST and g["n_removed"] >= size)
    left = repeats.without_repeats(docs, repeats.PASSAGE).orderBy("doc_id").collect()
    assert all(passages[i // 2] not in x["text"] for i, x in enumerate(left[:30]))
    assert [x["text"] for x in left[30:]] == texts[30:]


def planted(r):
    """(text, kind): prose, and junk that shows in symbols, in separators, in capitals or in repeats."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    words = [word() for _ in range(r.randint(120, 200))]
    kind = r.choices(["prose", "symbols", "pipes", "short", "again"], [80, 6, 6, 4, 4])[0]
    if kind == "symbols":
        words = [w + r.choice(["###", "$$$", "%%%"]) for w in words]
    elif kind == "pipes":
        words = [x for w in words for x in (w, "|")]
    elif kind == "short":
        words = words[:20]
    elif kind == "again":
        words = words[:10] * 20
    return " ".join(words), kind


def plain_em(patterns, n_rules):
    """The estimate by straight loops, rule by rule."""
    total = sum(patterns.values())
    good = {v: 0.1 if 0 in v else 0.9 for v in patterns}
    for _ in range(weakrules.ITERATIONS):
        prior = (sum(good[v] * n for v, n in patterns.items()) + 1) / (total + 2)
        p = []
        for k in range(n_rules):
            belief = weakrules.BELIEF * total
            counts = {(1, 0): 1 + 0.001 * belief, (1, 1): 1 + 0.999 * belief, (0, 0): 1 + 0.5 * belief, (0, 1): 1 + 0.5 * belief}
            for v, n in patterns.items():
                if v[k] < 2:
                    counts[1, v[k]] += good[v] * n
                    counts[0, v[k]] += (1 - good[v]) * n
            p.append({(c, x): counts[c, x] / (counts[c, 0] + counts[c, 1]) for c in (0, 1) for x in (0, 1)})
        for v in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(p[k][1, x] / p[k][0, x]) for k, x in enumerate(v) if x < 2)
            good[v] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return good


def test_verdict_by_plain_estimate(spark):
    r = random.Random(5)
    made = [planted(r) for _ in range(500)] + [("", "short"), (None, "short")]
    docs = spark.createDataFrame([(i, t, None, None, None, None) for i, (t, _) in enumerate(made)], SCHEMA).repartition(3)
    names = [f"vote_{n}" for n in weakrules.rules()]
    got = weakrules.judge(docs).orderBy("doc_id").collect()
    patterns = collections.Counter(tuple(g[c] for c in names) for g in got if not g["base_failed"])
    good = plain_em(patterns, len(names))
    for g, (_, kind) in zip(got, made, strict=True):
        assert g["base_failed"] == (kind in ("short", "again")), kind
        if not g["base_failed"]:
            assert g["p_good"] == pytest.approx(good[tuple(g[c] for c in names)], abs=1e-9)
        assert g["kept"] == (kind == "prose"), (kind, g)


def test_verdict_goes_beyond_the_base_rule(spark):
    """On the given labels, which the rules never see: junk beyond the base rule goes, good documents stay."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op8_quality_rules"](spark, sf).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg({"*": "count", "kept": "max"}).collect()
    kept = QUERIES["op8_quality_rules"](spark, sf).where("kept").join(labels, "doc_id").groupBy("quality").count().collect()
    before, after = {x["quality"]: x["count(1)"] for x in rows}, {x["quality"]: x["count"] for x in kept}
    assert before[0] > 10 and after.get(0, 0) < 0.1 * before[0] and after[1] > 0.97 * before[1]


def test_mix_of_rows_without_ids_or_of_one_id(spark):
    """Sources of rows that share an id come near their targets, as others do."""
    rows = [(None if s == "a" else 7 if s == "b" else 1000 + i, f"{s} {i} " + "word " * 48, None, s, None, None) for s in "abcd" for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 4
    for r in got:
        assert abs(r["taken"] - r["target"]) <= 50, r


def test_pages_in_linear_time():
    """40,000 nested, misnested or unclosed tags."""
    n = 40_000
    for page in ("<div><span>" * n + "text" + "<li>" * n, "<div>" * n + "</b>" * n + "some text", "<table><tr><td>" * n + "words", "<p><ul>" * n):
        t = time.process_time()
        htmltext.main_text(page)
        assert time.process_time() - t < 6


def test_odd_pages_and_labels(spark):
    pages = [(1, "u", None, "x", 2), (1, "u", "", "x", 2), (2, None, "<p>", "x", 2), (None, "v", "plain words", "x", 2), (3, "w", "<p>One &amp; two</p>" * 3, "x", 2)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars long")
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in htmltext.extract(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", "", 0), (1, "u", "", 0), (2, None, "", 0), (None, "v", "plain words", 11), (3, "w", "\n".join(["One & two"] * 3), 29)], key=str)
    assert htmltext.extract(df.limit(0)).count() == 0
    names = list(rulefit.features())
    rows = [(i if i % 7 else None, None if i % 3 == 0 else i % 2, float(i % 2)) for i in range(60)] * 2
    labelled = spark.createDataFrame(rows, "doc_id long, label int, x double").select("doc_id", "label", *[F.col("x").alias(n) for n in names])
    model = rulefit.fit(labelled.where("label is not null"))
    scores = [r["s"] for r in labelled.select(model.score().alias("s")).collect()]
    assert len(scores) == 120 and all(0 <= s <= 1 for s in scores)


def test_fingerprints_of_text_ids(spark):
    """1,200 rows with ids as text, some null or repeated: every row meets the next one in the order of (id, text)."""
    r = random.Random(6)
    rows = [(f"doc-{r.randint(0, 900):05d}" if i % 40 else None, "".join(r.choice("abcdefg ") for _ in range(r.randint(0, 60)))) for i in range(1200)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id string, text string, rng string, ahead int").repartition(4)
    got = ordermin.fingerprints(docs).collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1].encode()))
    want = collections.Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        quarter = len(t) // 4
        want[i, len(t), hashlib.sha256((t[: len(t) - quarter] + after[:quarter]).encode()).hexdigest()] += 1
    assert collections.Counter((g["doc_id"], g["n_chars"], g["edited_sha256"]) for g in got) == want
