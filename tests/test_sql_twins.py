"""Every query with a SQL twin must give the same rows on DuckDB."""

import duckdb
import pytest

from panelmill.plans import load_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = load_queries()
# left to tools/check.py to keep the suite short
SLOW = {"cross_validation", "best_forecaster", "ml_ensemble", "ml_forest", "ml_feature_selection", "unified_report", "quality_trends", "quality_alerts"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SLOW))
def test_query(name, spark, duck, sf):
    q = QUERIES[name]
    df = q.run(spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    assert len(set(c.lower() for c in cols)) == len(cols)
    if q.sql is None:
        assert got
        return
    rel = duck.execute(q.sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        for c, x, y in zip(cols, a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert x == pytest.approx(y, rel=1e-9, abs=2e-6), c
            else:
                assert x == y, c
