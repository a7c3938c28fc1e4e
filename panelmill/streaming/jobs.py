"""Streaming counterparts of the batch operators.

Inputs are streaming DataFrames with the batch columns; every job bounds its
state with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import validation
from ..sources.sinks import append_history

C = F.col


def daily_sentiment_stream(events: DataFrame, late: str = "1 day", key: str = "symbol", ts: str = "ts", score: str = "sentiment_score", strong: float = 0.1) -> DataFrame:
    """Scored events to closed daily rows per symbol (append mode).

    All measures are mergeable sums, so the state per open day is one row.
    """
    s = C(score)
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 day").alias("w"), key)
        .agg(
            F.avg(s).alias("sentiment_mean"),
            F.stddev_samp(s).alias("sentiment_std"),
            F.min(s).alias("sentiment_min"),
            F.max(s).alias("sentiment_max"),
            F.count(F.lit(1)).alias("news_volume"),
            F.count_if(s > strong).alias("positive_sentiment_count"),
            F.count_if(s < -strong).alias("negative_sentiment_count"),
        )
        .select(key, F.to_date(C("w")["start"]).alias("date"), *["sentiment_mean", "sentiment_std", "sentiment_min", "sentiment_max", "news_volume", "positive_sentiment_count", "negative_sentiment_count"])
    )


def first_articles(articles: DataFrame, late: str = "1 day", ts: str = "publishedAt", url: str = "url") -> DataFrame:
    """Articles with a url not seen within the watermark."""
    return articles.withWatermark(ts, late).dropDuplicatesWithinWatermark([url])


def minute_bars(quotes: DataFrame, width: str = "1 minute", late: str = "5 minutes", key: str = "symbol", ts: str = "ts", price: str = "price", size: str = "size", seq: str | None = None) -> DataFrame:
    """Quotes to OHLCV bars; the close is the latest quote of the bar."""
    order = F.struct(ts, seq) if seq else C(ts)
    p = C(price)
    return (
        quotes.withWatermark(ts, late)
        .groupBy(F.window(ts, width).alias("w"), key)
        .agg(F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"), F.sum(size).alias("volume"))
        .select(key, C("w")["start"].alias("ts"), "open", "high", "low", "close", "volume")
    )


_ROW = np.dtype([("us", "<i8"), ("close", "<f8"), ("volume", "<f8")])


def _block(us: np.ndarray, close: np.ndarray, volume: np.ndarray) -> np.ndarray:
    rows = np.empty(len(us), dtype=_ROW)
    rows["us"], rows["close"], rows["volume"] = us, close, volume
    return rows


class _OrderedState(StatefulProcessor):
    """EMA and OBV of one symbol, in event-time order.

    Rows wait in ``pending`` until the watermark has passed them, as an earlier one may still come. A timer at the earliest
    waiting row takes them through; with none waiting, a timer at the last row plus ``idle`` clears what is known of
    the symbol. A row more than ``idle`` after the one before it starts afresh either way, so results depend on the
    rows alone and not on how they fell into batches.
    """

    def __init__(self, key: str, alpha: float, idle_us: int):
        self.key, self.alpha, self.idle_us = key, alpha, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint, close double, ema double, obv double")
        # rows as blocks of bytes: the state store takes every value by itself, and a block is one
        self.pending = handle.getListState("pending", "rows binary")
        self.timer = handle.getValueState("timer", "ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [_block(chunk["us"].to_numpy(), chunk["close"].to_numpy(), chunk["volume"].to_numpy()) for chunk in rows]
        self.pending.appendList([(b.tobytes(),) for b in new])
        self._wake(min(int(b["us"].min()) for b in new), self.timer.get())
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(r for (b,) in self.pending.get() for r in np.frombuffer(b, dtype=_ROW).tolist())
        ready = [r for r in waiting if r[0] <= closed]
        rest = waiting[len(ready) :]
        state = self.last.get()
        made = []
        for us, close, volume in ready:
            if state is None or us - state[0] > self.idle_us:
                state = (us, close, close, 0.0)
            else:
                step = (close > state[1]) - (close < state[1])
                state = (us, close, self.alpha * close + (1 - self.alpha) * state[2], state[3] + step * volume)
            made.append((key[0], *state))
        if rest:
            self.pending.put([(np.array(rest, dtype=_ROW).tobytes(),)])
        elif waiting:
            self.pending.clear()
        if state is not None and (rest or closed < state[0] + self.idle_us):
            if made:
                self.last.update(state)
            self._wake(rest[0][0] if rest else state[0] + self.idle_us)
        else:
            self.last.clear()
            if rest:
                self._wake(rest[0][0])
            else:
                self.timer.clear()
        if made:
            yield pd.DataFrame(made, columns=[self.key, "us", "close", "ema", "obv"])

    def _wake(self, us: int, known: tuple[int] | None = None) -> None:
        """One timer per symbol, at the earliest moment asked for; ``known`` is the one that is set."""
        ms = -(-us // 1000)
        if known is not None:
            if known[0] <= ms:
                return
            self.handle.deleteTimer(known[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def close(self) -> None:
        pass


def running_state(
    bars: DataFrame, span: int = 12, key: str = "symbol", ts: str = "ts", price: str = "close", volume: str = "volume", late: str = "1 day", idle: str = "30 days"
) -> DataFrame:
    """EMA and OBV of each symbol at once, as its rows arrive: constant state (last time, price, EMA, OBV) per symbol.

    Within a batch rows are sorted; a row that comes after a later one of its symbol is left out, as is one behind the
    watermark. The state of a symbol goes once the watermark is ``idle`` past its last row. ``ordered_state`` waits instead.
    """
    a = 2 / (span + 1)
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    out = f"{key} string, ts timestamp, close double, ema double, obv double"

    def step(k: Any, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last, ema, obv = state.get if state.exists else (None, None, None, 0.0)
        rows = pd.concat(list(chunks)).sort_values(ts)
        made = []
        for t, p, v in zip(rows[ts], rows[price], rows[volume], strict=True):
            if seen is not None and t.value // 1000 < seen:
                continue
            ema = p if ema is None else a * p + (1 - a) * ema
            obv += 0.0 if last is None or p == last else (v if p > last else -v)
            seen, last = t.value // 1000, p
            made.append((k[0], t, p, ema, obv))
        state.update((seen, last, ema, obv))
        state.setTimeoutTimestamp(max(seen // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(made, columns=[key, "ts", "close", "ema", "obv"])

    shaped = bars.select(C(key).cast("string").alias(key), C(ts).cast("timestamp").alias(ts), C(price).cast("double").alias(price), C(volume).cast("double").alias(volume))
    return (
        shaped.withWatermark(ts, late)
        .groupBy(key)
        .applyInPandasWithState(step, out, "seen long, last double, ema double, obv double", "append", GroupStateTimeout.EventTimeTimeout)
    )


def ordered_state(
    bars: DataFrame, span: int = 12, key: str = "symbol", ts: str = "ts", price: str = "close", volume: str = "volume", late: str = "1 day", idle: str = "30 days"
) -> DataFrame:
    """EMA and OBV of each symbol in event-time order, append mode; rows come out once the watermark has passed them.

    Rows may come in any order within ``late``; later ones are dropped before they reach the state, and ``late_rows`` counts
    them. A symbol without rows for ``idle`` leaves no state behind, and starts afresh with its next row. Needs the RocksDB
    state store (``STORE``).
    """
    shaped = bars.select(
        C(key).cast("string").alias(key), C(ts).cast("timestamp").alias(ts), F.unix_micros(C(ts).cast("timestamp")).alias("us"), C(price).cast("double").alias("close"), C(volume).cast("double").alias("volume")
    )
    step = _OrderedState(key, 2 / (span + 1), int(pd.Timedelta(idle).total_seconds() * 1_000_000))
    made = shaped.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(step, f"`{key}` string, us bigint, close double, ema double, obv double", "append", "EventTime")
    return made.select(key, F.timestamp_micros("us").alias(ts), "close", "ema", "obv")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped so far because the watermark had passed them."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> StreamingQuery:
    """Take in all that a stream has to offer now, into ``folder``/out, going on from ``folder``/checkpoint."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        sink = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out")
        query = sink.trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE[0], before)
    query.awaitTermination()
    return query


def replay(table: DataFrame, ts: str, job: Callable[[DataFrame], DataFrame], folder: str, parts: int = 3) -> DataFrame:
    """What a streaming job makes of a table that comes in in ``parts`` stretches of time, the query stopping in between.

    Each stretch is appended to a folder of files and drained from the checkpoint the one before has left. ``table`` should be
    a plain scan, as it is read once per stretch.
    """
    spark = table.sparkSession
    low, high = table.agg(F.min(F.unix_micros(C(ts).cast("timestamp"))), F.max(F.unix_micros(C(ts).cast("timestamp")))).first()
    at = F.unix_micros(C(ts).cast("timestamp"))
    for i in range(parts):
        cut = [None if low is None else low + (high - low) * k // parts for k in (i, i + 1)]
        here = table if low is None else table.where((at >= cut[0]) & ((at < cut[1]) | F.lit(i == parts - 1)))
        here.write.mode("append").parquet(f"{folder}/in")
        drain(job(spark.readStream.schema(table.schema).parquet(f"{folder}/in")), folder)
    return spark.read.parquet(f"{folder}/out")


def quality_sink(history: str, kind: str = "market", **kw) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: validate each micro-batch and append its issues with the batch id.

    A batch that is replayed after a failure is written once: rows of an id
    already in the history are skipped.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(history)
        known = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        # any failure to read an existing history stops the batch, rather than write it twice
        if known and not spark.read.schema("batch_id int").parquet(history).filter(C("batch_id") == batch_id).isEmpty():
            return
        issues, _ = validation.validate(batch, kind, **kw)
        append_history(issues.withColumn("batch_id", F.lit(batch_id)), history)

    return write
