"""Operators of the training-data folder against brute force, on small and odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelmill.llm import htmltext, jaccard, langid, licences, mixing, ordermin, packing, repeats, rulefit, textstats, weakrules
from panelmill.llm.components import components
from panelmill.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", "   \n\t ", "one", "one two", "one two", "ünï ☃ 日本語 \U0001f600", "\n\n\n", "x " * 3000, "word" * 4000, "a b c d e f g h a b c d e f g h"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i % 9 if i != 4 else None, t, "en" if i % 2 else None, "s" if i % 3 else None, None, "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_odd_and_empty_tables(spark, odd, empty):
    model = langid.train(odd)
    for docs, n in ((odd, len(ODD)), (empty, 0)):
        assert len(repeats.deduplicate(docs).collect()) == n
        assert len(jaccard.classes(docs).collect()) == n
        assert len(langid.identify(docs, model).collect()) == n
        assert len(langid.identify(docs, langid.train(docs)).collect()) == n
        assert len(licences.scan(docs).collect()) == n
        assert len(mixing.mix(docs).collect()) == n
        assert len(weakrules.judge(docs).collect()) == n
        assert len(ordermin.fingerprints(docs).collect()) == n
        assert len(packing.pack(docs, TOKENIZER).select("doc_id", "start", "sequence_id", "offset").where("start = 0").collect()) == n
        assert repeats.without_repeats(docs).columns == docs.columns == jaccard.one_of_each(docs).columns == mixing.mixed(docs).columns
        assert mixing.mixed(docs).count() >= 0 and repeats.without_repeats(docs).count() == n


def brute_repeats(texts, least):
    seen = collections.Counter(t[s : s + least] for t in texts for s in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - least + 1):
            if seen[t[s : s + least]] > 1:
                gone[s : s + least] = b"\x01" * least
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [100_000, 2])
def test_repeats(spark, monkeypatch, group):
    """Random texts over few letters, so that repeats overlap, nest and lie inside one text; also by counted windows."""
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    r = random.Random(group)
    parts = ["".join(r.choice("ab") for _ in range(r.randint(5, 40))) for _ in range(12)]
    texts = ["".join(r.choice(parts) if r.random() < 0.5 else "".join(r.choice("abcdé") for _ in range(25)) for _ in range(r.randint(0, 9))) for _ in range(60)]
    texts += [texts[3], "ab" * 60, "", "ab" * 40 + "c"]
    for least, passage in ((16, 16), (16, 9), (24, 10)):
        got = {x.doc_id: x for x in repeats.deduplicate(frame(spark, texts).repartition(4), least, passage).collect()}
        shorter = brute_repeats([t.encode() for t in texts], passage)
        for i, want in enumerate(brute_repeats([t.encode() for t in texts], least)):
            g = got[i]
            assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == want, i
            assert g.n_passage == shorter[i][1], i


def test_prefix_intervals_give_all_occurrences():
    left, right = [b"x1", b"x2", b"x3", b"y"], [b"abcdZ", b"abcdY", b"abcX", b"q"]
    groups = list(repeats.maximal_repeats(left, right, 4, 1))
    assert (3, 3, [(0, 1), (1, 1), (2, 1)]) in groups and any(upto == 4 and n == 2 for upto, n, _ in groups)


def brute_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    links, root = collections.Counter(), list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links.update((i, j))
            if (sets[i] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9) or sets[i] == sets[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(find(i), links[i]) for i in range(len(sets))]


@pytest.mark.parametrize("block", [3_000_000, 300])
def test_jaccard(spark, block):
    """Near copies, chains of near copies, exact copies and short texts; in one task and in blocks."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(60)]
        for _ in range(r.randint(1, 9)):
            texts.append(" ".join(base))
            if r.random() < 0.8:
                base = list(base)
                base[r.randrange(60)] = word()
    texts += [texts[0], "short text", "short text", "", None]
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.classes(frame(spark, texts).repartition(3), block=block).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    stay = {x.doc_id for x in jaccard.one_of_each(frame(spark, texts)).collect()}
    assert stay == {c for c, _ in brute_classes(texts)}


def test_jaccard_counts_links_once_with_empty_blocks(spark):
    """Few sets over many blocks: most blocks hold none of them."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = []
    for size in (2, 2, 2, 3, 3):
        base = [word() for _ in range(80)]
        texts += [" ".join([*base, f"end{k}"]) for k in range(size)]
    want = brute_classes(texts)
    for block in (20, 60, 100):
        got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.classes(frame(spark, texts), block=block).collect()}
        assert [got[i] for i in range(len(texts))] == want, block


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(20)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert all(got[x] == find(x) for x in root if find(x) != x or x in got)


def test_main_text():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>menu</a></nav><header>Site</header><div class='ad'>buy</div>"
        "<article><header><h1>Head</h1></header><p>First &amp; long paragraph of <b>some</b>\n text &copy; &#65;.<p>Second paragraph, longer than the first one.<br></p>"
        "<div class=sidebar>side</div><section id=comments><p>A reader's comment that is very long indeed, much longer.</p></section><form><p>mail</p></form></article>"
        "<aside>aside</aside><footer>foot</footer><script>var a='<p>';</script></body>"
    )
    assert htmltext.main_text(page) == "Head\nFirst & long paragraph of some text © A.\nSecond paragraph, longer than the first one."
    assert htmltext.main_text("<") == "<"
    for odd in (None, "", "<p", "</p></div>", "<script>", "<!--", "<div>" * 2000, "<a '" * 500):
        assert htmltext.main_text(odd) == ""
    assert htmltext.main_text("plain") == "plain" and htmltext.main_text("<p>a<p>b") == "a\nb"


def test_main_text_inside_marked_wrappers():
    text = ["The first paragraph of an article that has enough words.", "A second paragraph of it, with some more words to read."]
    body = "".join(f"<p>{t}</p>" for t in text)
    around = "<ul class=menu><li><a href=/>Home</a></li></ul>{}<div class=sidebar>side</div><div id=comments><p>Nice.</p></div>"
    for name in ("content no-sidebar", "has-sidebar", "with-left-sidebar", "widget-page", "search-results", "social-article"):
        for wrapped in (f"<div class='{name}'>{body}</div>", f"<div id='{name}'><article>{body}</article></div>", f"<main><div class='{name}'>{body}</div></main>"):
            assert htmltext.main_text(f"<html><body>{around.format(wrapped)}</body></html>") == "\n".join(text), wrapped
    assert htmltext.main_text(f"<html><body><form>{around.format(body)}<input name=q></form></body></html>") == "\n".join(text)
    long = "<p>A reader's comment, and longer than the article is.</p>" * 9
    assert htmltext.main_text(f"<body><article>{body}</article><div id=comments>{long}</div></body>") == "\n".join(text)


def test_main_text_without_head_end_tag():
    head, text = "<html><head><meta charset=utf-8><title>t</title><style>p{}</style><noscript><p>no script</p></noscript>", "A paragraph of the article."
    assert htmltext.main_text(f"{head}<body><p>{text}") == text
    assert htmltext.main_text(f"{head}<p>{text}") == text
    assert htmltext.main_text(f"{head}{text}") == text
    assert htmltext.main_text(f"{head}<noscript><body><p>{text}") == text
    assert htmltext.main_text(f"{head}</head><body><p>{text}</p></body></html>") == text


def test_extract_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    assert [tuple(x) for x in htmltext.extract(pages).orderBy("page_id").collect()] == [(1, "u", "x", 1), (2, None, "", 0)]


def test_text_stats(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "b", "c", "dd", "#x", "é|"]) + r.choice(["", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(80)] + ODD
    got = {x.doc_id: x for x in textstats.with_text_stats(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[i]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want, i


def test_weak_rules_learn_what_votes_mean():
    # junk shows in two rules, now and then in both: with a single sign there would be nothing to tell junk from noise
    patterns = [((1, 1, 1), 900), ((1, 0, 0), 50), ((1, 0, 1), 20), ((2, 1, 1), 40)]
    prior, table = weakrules.fit(patterns, 3)
    assert prior > 0.8 and weakrules._odds(prior, table, (1, 1, 1)) > 0 > weakrules._odds(prior, table, (1, 0, 0))


def test_rule_model(spark):
    rows = [(i, float(i % 10), 1 if i % 10 < 7 else 0) for i in range(400)]
    names = list(rulefit.features())
    df = spark.createDataFrame(rows, "doc_id long, words double, label int").select("doc_id", "label", *[(F.col("words") if n == "words" else F.lit(0.0)).alias(n) for n in names])
    model = rulefit.fit(df)
    assert all((x.s >= 0.5) == (x.label == 1) for x in df.select("label", model.score().alias("s")).collect())
    one = rulefit.fit(df.where("label = 1"))
    assert one.weights == [] and 0.5 < df.select(one.score().alias("s")).head().s < 1


def test_language_spans(spark):
    english = "the house and the garden with some flowers in it that were there "
    french = "la maison et le jardin avec des fleurs qui étaient là depuis longtemps "
    docs = spark.createDataFrame([(english * 5, "en"), (french * 5, "fr")] * 20, "text string, lang string")
    model = langid.train(docs)
    lang, score, spans = langid.label(english * 3 + french * 2, model)
    assert lang == "en" and 0 < score <= 1 and [s[2] for s in spans] == ["en", "fr"]
    assert langid.label(None, model) == langid.label("123 !?", model) == ("und", 0.0, [])
    scores = np.random.default_rng(1).normal(0, 9, (60, 3))
    best = max(_paths(scores[:7]), key=lambda p: p[0])[1]
    assert langid._viterbi(scores[:7]).tolist() == best


def _paths(scores):
    import itertools

    for p in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        yield sum(scores[i, x] for i, x in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False)), list(p)


def test_licences(spark):
    assert len(licences.rules()) > 200
    texts = [
        "Licensed under CC BY-NC 4.0. Also: CC-BY!", "This work is licensed under the GNU General Public License, version 3.", "mit license MIT License", "Released under the Apache License, Version 2.0", "no rights", None,
    ]
    got = [x for x in licences.scan(frame(spark, texts)).orderBy("doc_id").collect()]
    assert [x.labels for x in got] == ["cc-by,cc-by-nc", "gpl,gpl-3.0", "mit", "apache,apache-2.0", "", ""]
    assert [(x.n_base, x.first_word, x.last_word) for x in got] == [(2, 2, 8), (1, 6, 6), (2, 0, 2), (1, 3, 3), (0, None, None), (0, None, None)]
    assert [x.base_labels for x in got] == ["cc-by", "gpl", "mit", "apache", "", ""] and all(0 <= x.score <= 1 for x in got)
    assert all(len(x.found) == n for x, n in zip(got, (2, 1, 2, 1, 0, 0), strict=True))


def test_licences_by_their_own_text(spark):
    texts = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
        "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-3-clause",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        'Unless required by applicable law or agreed to in writing, software\n distributed under the License is distributed on an "AS IS" BASIS': "apache-2.0",
        "This library is free software; you can redistribute it and/or modify it as follows": "",
        "see http://www.apache.org/licenses/LICENSE-2.0 for it": "apache-2.0",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl,gpl-2.0",
        "The Software is provided \u201cas is\u201d, and the author disclaims all warranties with regard to this software": "isc",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
        "Permission is granted to anyone, free, to use the garden": "",
        " ".join(gate for _, gate, *_ in licences.TEXTS): None,  # every pattern is tried
    }
    got = [x.labels for x in licences.scan(frame(spark, list(texts))).orderBy("doc_id").collect()]
    assert got[:-1] == list(texts.values())[:-1] and got[-1]
    patterns = [x[-1] for x in [*licences.LICENCES, *licences.TEXTS]]
    assert len(set(patterns)) == len(patterns) >= 170


def test_fingerprints(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 900))) for _ in range(40)] + ["", "ab", "ab"]
    got = sorted(ordermin.fingerprints(frame(spark, texts).repartition(5)).collect())
    assert [x.doc_id for x in got] == list(range(len(texts)))
    for i, x in enumerate(got):
        t, n = texts[i], texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert x.fingerprint == ordermin.as_text(ordermin.signature(t)) and x.edited_fingerprint == ordermin.as_text(ordermin.signature(edited))
        assert x.near_next == ordermin.likeness(ordermin.signature(t), ordermin.signature(n))
    a = "".join(r.choice("abcdefgh ") for _ in range(2000))
    assert ordermin.likeness(ordermin.signature(a), ordermin.signature(a[1000:] + a[:1000])) < 1.0


@pytest.mark.parametrize("simple", [True, False])
def test_token_ids_equal_the_tokenizers(simple):
    r = random.Random(5)
    plain = [*"abzAZ09 \n\t'!_-.;[`~éÉßÀÿ", "'s", "'re", "'VE", "n't", "<|"]
    odd = [*plain, "́", "İ", "Σ", "ﬁ", "٣", "<|endoftext|>", "\x1c", "\x85", "​", "　", " ", "日", "\U0001f44d", "\x00", "K", "²", "ª", "×"]
    texts = ["".join(r.choice(plain if simple else odd) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    want = Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)
    got = packing.WordIds(TOKENIZER).encode(texts)
    assert all(g.tolist() == w.ids for g, w in zip(got, want, strict=True))


def test_plain_runs_go_to_the_model_alone():
    """Runs of plain text are learned without the tokenizer's normaliser and cut, and folded over texts first."""
    ids_of = packing.WordIds(TOKENIZER)
    ids_of.tokenizer = None
    texts = ["It's ÉTÉ, don't!! 42 we'LL ''s x'y", "", " \n", "été 's't 're"]
    want = Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in ids_of.encode(texts)] == [w.ids for w in want]


def test_pack_round_trip(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma?"]) for _ in range(r.choice([0, 3, 200, 900, 6000]))) for _ in range(150)] + [None, ""]
    rows = packing.pack(frame(spark, texts), TOKENIZER).toPandas()
    tok = Tokenizer.from_file(TOKENIZER)
    for i, g in rows.groupby("doc_id"):
        ids = np.array(tok.encode(texts[i] or "", add_special_tokens=False).ids + [2], "<u4")
        assert g.length.sum() == len(ids) == g.doc_tokens.iloc[0]
        for x in g.itertuples():
            assert zlib.crc32(ids[x.start : x.start + x.length].tobytes()) == x.ids_crc32
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 4096 and g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    assert rows.length.sum() / 4096 / rows.sequence_id.nunique() > 0.9


def test_equal_pieces_are_dealt_to_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    docs = spark.createDataFrame([(None, "alpha beta gamma")] * 600, "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, TOKENIZER).withColumn("block", F.expr("shiftright(sequence_id, 32)")).groupBy("block").count().collect()
    assert sum(x["count"] for x in rows) == 600 and max(x["count"] for x in rows) < 150


def test_differencing():
    r = random.Random(7)
    sizes = [r.randint(1, 900) for _ in range(300)]
    found = packing.windows(sizes, 4096)
    assert sorted(i for w in found for i in w) == list(range(300)) and max(sum(sizes[i] for i in w) for w in found) <= 4096
    assert len(found) <= -(-sum(sizes) // 4096) + 1


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(want, key=str)


def test_entry_lists_all_operators_and_the_pipeline():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {re.match(r"op\d+", n)[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
