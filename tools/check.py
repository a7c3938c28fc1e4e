"""Run queries on Spark and their SQL twins on DuckDB and compare rows.

usage: python tools/check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from panelmill.plans import load_queries  # noqa: E402
from panelmill.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, q in load_queries().items():
        if args.names and not any(n in name for n in args.names):
            continue
        try:
            t0 = time.time()
            df = q.run(spark, sf_dir)
            cols = sorted(df.columns)
            rows = [tuple(r) for r in df.select(*cols).collect()]
            t1 = time.time()
            if q.sql is None:
                print(f"ROWS {name}: {len(rows)} rows  {t1 - t0:.2f}s")
                continue
            rel = con.execute(q.sql)
            names = [d[0] for d in rel.description]
            idx = [names.index(c) for c in cols]
            want = [tuple(r[i] for i in idx) for r in rel.fetchall()]
            t2 = time.time()
            kinds = dict(zip(names, [str(d[1]) for d in rel.description]))
            types = {c: (t, kinds[c]) for c, t in df.dtypes if {"BIGINT": "NUMBER", "INTEGER": "NUMBER", "DOUBLE": "NUMBER", "VARCHAR": "STRING", "BOOLEAN": "bool"}.get(TYPES.get(t, t), t).lower() != kinds[c].lower() and TYPES.get(t, t).lower() != kinds[c].lower()}
            key = lambda r: tuple((v is None, str(v)) for v in r)
            rows.sort(key=key)
            want.sort(key=key)
            ok = rows == want and sorted(names) == cols
            print(f"{'ok  ' if ok else 'FAIL'} {name}: {len(rows)} rows, {len(cols)} cols  spark {t1 - t0:.2f}s duck {t2 - t1:.2f}s{'  types ' + str(types) if types else ''}", flush=True)
            if not ok:
                bad += 1
                print("   sql rows", len(want))
                diff: dict[str, int] = {}
                shown = 0
                for a, b in zip(rows, want):
                    for c, x, y in zip(cols, a, b):
                        if x != y:
                            diff[c] = diff.get(c, 0) + 1
                    if a != b and shown < 3:
                        shown += 1
                        print("   ", {c: (x, y) for c, x, y in zip(cols, a, b) if x != y}, [v for v in a if isinstance(v, str)][:3])
                print("   differing", diff)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name}: {type(e).__name__}: {str(e)[:1500]}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
