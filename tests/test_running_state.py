"""The ordered state of a stream: order within the lateness, late rows, idle symbols, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelmill.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, close double, volume double"


def want(rows, span=3, idle=dt.timedelta(days=30)):
    """EMA and OBV by a plain loop over each symbol's rows in time order."""
    out, last = {}, {}
    for s, t, p, v in sorted(rows):
        known = last.get(s)
        if known is None or t - known[0] > idle:
            now = (t, p, p, 0.0)
        else:
            a = 2 / (span + 1)
            now = (t, p, a * p + (1 - a) * known[2], known[3] + (v if p > known[1] else -v if p < known[1] else 0))
        last[s] = out[s, t] = now
    return {k: (v[1], v[2], v[3]) for k, v in out.items()}


def feed(spark, rows, folder, **kw):
    """One more batch of rows into the running query."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    return jobs.drain(jobs.ordered_state(stream, span=3, **kw), folder)


def got(spark, folder):
    return {(r["symbol"], r["ts"]): (r["close"], pytest.approx(r["ema"]), pytest.approx(r["obv"])) for r in spark.read.parquet(f"{folder}/out").collect()}


def day(n, hours=0):
    return T0 + dt.timedelta(days=n, hours=hours)


def test_any_order_within_the_lateness(spark, tmp_path):
    r = random.Random(1)
    rows = [(s, day(i, h), float(r.randint(1, 9)), float(r.randint(1, 5))) for s in "ABC" for i in range(20) for h in (0, 7)]
    moved = sorted(rows, key=lambda x: x[1] + dt.timedelta(hours=r.uniform(0, 40)))  # up to 40 hours out of order
    third = len(moved) // 3
    queries = [feed(spark, part, tmp_path, late="2 days") for part in (moved[:third], moved[third : 2 * third], moved[2 * third :])]
    assert sum(map(jobs.late_rows, queries)) == 0
    closed = max(x[1] for x in rows) - dt.timedelta(days=2)
    assert got(spark, tmp_path) == {k: v for k, v in want(rows).items() if k[1] <= closed}


def test_late_row_is_dropped_and_counted(spark, tmp_path):
    first = [("A", day(i), float(i % 4 + 1), 1.0) for i in range(10)]
    assert jobs.late_rows(feed(spark, first, tmp_path)) == 0
    late = [("A", day(3, 5), 99.0, 1.0), ("B", day(1), 5.0, 1.0)]
    rest = [("A", day(i), 2.0, 1.0) for i in range(10, 14)]
    assert jobs.late_rows(feed(spark, late + rest, tmp_path)) == 2
    found = got(spark, tmp_path)
    assert found == {k: v for k, v in want(first + rest).items() if k[1] <= day(12)}


def test_idle_symbol_leaves_no_state(spark, tmp_path):
    idle = [("A", day(i), float(i + 1), 1.0) for i in range(3)]
    busy = [("B", day(i), float(i % 3), 1.0) for i in range(10)]
    query = feed(spark, idle + busy, tmp_path, idle="4 days")
    # day 8 is closed: A, last seen on day 2, is gone; B has a last row, two waiting rows at most, and a timer
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/checkpoint")
    assert [r["key"]["symbol"] for r in state.collect()] == ["B"]
    timers = spark.read.format("statestore").option("readRegisteredTimers", "true").load(f"{tmp_path}/checkpoint")
    assert [r["key"]["symbol"] for r in timers.collect()] == ["B"]
    again = [("A", day(12), 50.0, 2.0), ("A", day(13), 60.0, 2.0), ("B", day(15), 1.0, 1.0)]
    feed(spark, again, tmp_path, idle="4 days")
    rows = idle + busy + again
    assert got(spark, tmp_path) == {k: v for k, v in want(rows, idle=dt.timedelta(days=4)).items() if k[1] <= day(14)}
    assert got(spark, tmp_path)["A", day(12)][1:] == (50.0, 0.0)  # afresh
    assert query.exception() is None


def test_restart_gives_the_same_rows(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"S{i % 7}", day(i // 7, i % 5), float(r.randint(1, 9)), 1.0) for i in range(140)]
    feed(spark, rows, f"{tmp_path}/once")
    for a in range(0, 140, 35):
        feed(spark, rows[a : a + 35], f"{tmp_path}/often")
    assert got(spark, f"{tmp_path}/once") == got(spark, f"{tmp_path}/often") != {}


def test_replay(spark, tmp_path):
    rows = [(f"S{i % 3}", day(i), float(i % 5), 1.0) for i in range(60)]
    table = spark.createDataFrame(rows, SCHEMA)
    out = jobs.replay(table, "ts", lambda s: jobs.ordered_state(s, span=3), str(tmp_path / "a"))
    assert {(r["symbol"], r["ts"]): (r["close"], pytest.approx(r["ema"]), pytest.approx(r["obv"])) for r in out.collect()} == {k: v for k, v in want(rows).items() if k[1] <= day(58)}
    none = jobs.replay(table.where(F.lit(False)), "ts", lambda s: jobs.ordered_state(s, span=3), str(tmp_path / "b"))
    assert none.count() == 0


def test_state_at_once_expires_and_leaves_out_late_rows(spark, tmp_path):
    def send(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        jobs.drain(jobs.running_state(stream, span=3, idle="4 days"), tmp_path)

    idle, busy = [("A", day(i), float(i + 1), 1.0) for i in range(3)], [("B", day(i), float(i % 3), 1.0) for i in range(10)]
    send(idle + busy)
    send([("A", day(12), 50.0, 2.0), ("B", day(9, -3), 9.0, 9.0), ("B", day(12), 1.0, 1.0)])
    found = got(spark, tmp_path)
    assert ("B", day(9, -3)) not in found and found["A", day(12)] == (50.0, 50.0, 0.0)
    rows = idle + busy + [("A", day(12), 50.0, 2.0), ("B", day(12), 1.0, 1.0)]
    assert found == want(rows, idle=dt.timedelta(days=4))


def test_waiting_rows_reach_the_state_as_one_value(monkeypatch):
    """The state store takes each value by itself, so the rows of a batch are put into one."""
    import pandas as pd

    put = []

    class State:
        def __getattr__(self, name):
            return lambda *a: put.extend(a[0]) if name == "appendList" else None

        def exists(self):
            return False

    class Handle:
        def __getattr__(self, name):
            return lambda *a: State()

    step = jobs._OrderedState("symbol", 0.5, 1)
    step.init(Handle())
    chunk = pd.DataFrame({"us": range(500), "close": 1.0, "volume": 2.0})
    list(step.handleInputRows(("A",), iter([chunk]), None))
    assert len(put) == 1
