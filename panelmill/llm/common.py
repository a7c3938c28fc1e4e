"""Helpers the operators of this folder share: written tables, and rows of text inside Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or for a local session without one a scratch folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    return _OWN.setdefault(app, tempfile.mkdtemp(prefix="panelmill-llm-"))


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Later passes plan from a plain file scan, a lost executor costs no more than the tasks it ran, and the table is
    removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def hinted(table: DataFrame, rows: int = 200_000) -> DataFrame:
    """A settled table with a broadcast hint if it has few rows by count; beyond that Spark joins it as it sees fit."""
    return F.broadcast(table) if table.count() <= rows else table


def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone already  # noqa: BLE001
            return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def crc_of_id(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts, so that what a worker builds from one stays small; freed memory goes back to the system."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
        pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # workers outlive their tasks; not every C library has this
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and where each row starts and ends in it; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), ends


def bitmap(ids: DataFrame, column: str, bits: int = 26) -> np.ndarray:
    """A set of 64-bit ids as 2**bits flags: 8 MB at most on the driver, whatever the number of ids. It never misses one;
    how many others pass grows with the number of ids, so it may only spare work, not decide."""
    words = ids.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("x")).groupBy(F.shiftright("x", 6).alias("i"))
    got = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("w")).toPandas()
    flags = np.zeros(1 << (bits - 6), np.int64)
    flags[got["i"].to_numpy(np.int64)] = got["w"].to_numpy(np.int64)
    return flags.view(np.uint64)


def flagged(flags: np.ndarray, ids: np.ndarray) -> np.ndarray:
    x = ids.view(np.uint64) & np.uint64(len(flags) * 64 - 1)
    return (flags[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) != 0


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
