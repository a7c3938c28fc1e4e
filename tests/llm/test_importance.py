"""Importance resampling against a plain version; the bracket on ties and on sketches that miss."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelmill.llm import importance

SCHEMA = "doc_id long, text string, score string, rank string, slots int"


def words(text):
    low = (text or "").translate(str.maketrans(importance.UPPER, importance.LOWER))
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def plain(docs, target, grams=1, buckets=10_000, percent=10, least=20):
    def slots(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(w) - n + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(slots(text))
    for text in target:
        t.update(slots(text))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        weight = sum(gain[b] for b in slots(text))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(slots(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    rank = {}
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        rank.setdefault(r[:4], []).append(k)
    return sorted(((*r[:4], rank[r[:4]].pop() if rank.get(r[:4]) else None) for r in rows), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", "y", 3) for i, t in docs], SCHEMA)


def target_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize("grams,buckets,percent", [(1, 10_000, 10), (2, 97, 37), (3, 1000, 100)])
def test_brute_force(spark, grams, buckets, percent):
    r = random.Random(grams)
    vocabulary = [f"w{i}" for i in range(40)] + ["Élan", "日本", "x9", "A-B"]
    docs = [(i if i % 50 else None, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(600)]
    docs += [(1000, None), (1001, ""), (1002, "..."), (5, docs[5][1]), (5, docs[5][1]), (1003, "w1 " * 20_000)]
    target = [" ".join(r.choice(vocabulary[:10]) for _ in range(30)) for _ in range(20)] + [None]
    got = importance.resample(frame(spark, docs).repartition(5), target_of(spark, target), grams, buckets, percent).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, target, grams, buckets, percent)


def test_empty_tables(spark):
    docs = [(i, "one two three " * 10) for i in range(5)]
    assert importance.resample(frame(spark, []), target_of(spark, ["a"])).count() == 0
    assert sorted(map(tuple, importance.resample(frame(spark, docs), target_of(spark, []), percent=50).collect()), key=str) == plain(docs, [], percent=50)
    short = importance.resample(frame(spark, [(1, "few words")]), target_of(spark, ["few"])).first()
    assert short["rank"] is None and short["n_features"] == 2


def scores(spark, values):
    return spark.createDataFrame([(i, 50, v, i) for i, v in enumerate(values)], "doc_id long, n_words long, score long, row long")


@pytest.mark.parametrize("shape", ["ties", "steps", "spread", "two"])
def test_cutoff(spark, shape, monkeypatch):
    r = random.Random(4)
    values = {"ties": [7] * 500, "steps": [r.randint(0, 5) for _ in range(900)], "spread": [r.randint(-(10**9), 10**9) for _ in range(900)], "two": [0] * 450 + [1] * 50}[shape]
    want = sorted(range(len(values)), key=lambda i: (-values[i], i))
    for accuracy in (10_000, 20):  # a coarse sketch misses, and wider brackets take over
        monkeypatch.setattr(importance, "ACCURACY", accuracy)
        for percent in (1, 10, 33, 100):
            got = importance.draw(scores(spark, values).repartition(4), percent).where("rank is not null").orderBy("rank").collect()
            assert [x["doc_id"] for x in got] == want[: percent * len(values) // 100]
            assert [x["rank"] for x in got] == list(range(1, len(got) + 1))


def test_bracket_is_confirmed_or_dropped(spark, monkeypatch):
    s = scores(spark, list(range(1000)))
    low, high, above = importance.bracket(s, 100, 1000)
    assert low <= 900 <= high and above == 999 - high and high - low < 10
    monkeypatch.setattr(importance, "WIDTHS", ())
    monkeypatch.setattr(F, "percentile_approx", lambda *a: F.lit([5, 6]))
    monkeypatch.setattr(importance, "WIDTHS", (1,))
    assert importance.bracket(s, 100, 1000) == (None, None, 0)  # both cuts are too low
