"""Fill-in-the-middle against a plain version."""

import hashlib

from pyspark.sql import functions as F

from panelmill.llm import infill
from panelmill.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, n string, form int, output string"


def plain(doc_id, text, units=None):
    """(n, form, prefix, middle, output) by slices."""
    text = text or ""
    units = list(text) if units is None else units
    sha = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(sha[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = [None, "", "a", "ab", "\n", "\r\n\r\n", "<P>", "x<M>y", "<", "<S", "S><P", "$1 \\2 ${x}", "日本語 🙂🙂", "é", " \x85", " lead and tail ", "a\nb\n\nc", "<<S>", "M>" * 5]


def test_brute_force(spark):
    rows = [(i if i % 11 else None, ODD[i % len(ODD)]) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(infill.digests(docs).collect(), key=str)
    want = []
    for i, t in rows:
        n, form, p, m, out = plain(i, t)
        want.append((i, n, form, p, m, sha(out), sha(t or "")))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(type(got[0])(**dict(zip(got[0].asDict(), r)))))
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}


def test_long_texts(spark):
    rows = [(i, "word% \n🙂 " * 60_000 + "end") for i in range(8)] + [(9, "x" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in infill.digests(docs).collect():
        text = dict(rows)[r["doc_id"]]
        n, form, p, m, out = plain(r["doc_id"], text)
        assert tuple(r)[1:] == (n, form, p, m, sha(out), sha(text))


def test_other_units(spark):
    rows = [(i, f"one  two\nthree {i}\n\nfour five" + " " * (i % 3)) for i in range(60)] + [(60, "   "), (61, " a"), (62, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    import re

    cut = {infill.LINE: lambda t: re.findall(r"[^\n]*\n|[^\n]+\Z", t), infill.WORD: lambda t: re.findall(r"\s*\S+(?:\s+\Z)?|\s+\Z", t)}
    for unit, units in cut.items():
        got = infill.infilled(docs, unit=unit).select("kept.doc_id", "n", "form", "a", (F.col("b") - F.col("a")).alias("m"), "output", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
        for r in got:
            text = dict(rows)[r["doc_id"]]
            assert "".join(units(text)) == text
            assert tuple(r)[1:] == (*plain(r["doc_id"], text, units(text)), text)


def test_kept_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "abc", "keep", 5, "me")], SCHEMA)
    row = infill.infilled(docs, keep=("doc_id", "n", "form", "output")).first()
    assert row["kept"].asDict() == {"doc_id": 3, "n": "keep", "form": 5, "output": "me"} and row["n"] == 3
    assert infill.digests(docs.limit(0)).count() == 0


def test_no_python_and_no_shuffle(spark, sf):
    plan = QUERIES["op12_fill_in_middle"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
