"""Documents as Huffman-coded token ids, in files that any number of tasks can read.

Format. A folder holds three tables:

* ``code``: (id, bits), the code length of every id that occurs. The code is canonical: ids in order of (bits, id) have
  codes that go up by one, shifted left where the length grows.
* ``blocks``: rows of (file, block, first, n_ids, doc_ids, sizes, bits, steps). A block is whole documents in ascending
  doc_id order, about BLOCK_IDS ids of them (a longer document is a block of its own): their ids, the numbers of ids of each,
  the code bits (most significant bit first), and the bits from one checkpoint to the next, STRIDE ids on (two bytes each,
  little-endian). ``first`` counts the ids of the file before the block. Nothing outside a row is needed to decode it
  but the code.
* ``files``: (file, n_ids, start), the ids of all files before.

Documents are tokenised once, into a settled table. Counts of ids are summed by task, then over the cluster, and only one
number per id of the vocabulary comes to the driver, where package-merge finds the code lengths. Files are ranges of
(doc_id, row), so equal or missing ids do not meet in one file; a file is encoded in one pass over its range.

Defined cases: a null or empty text is the end id alone; null ids come first; rows of one doc_id follow each other in the
order in which they were read; a table without rows gives a folder without blocks; a text of any length is cut where
the tokenizer never joins; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytebpe import SEGMENT, ByteWords, segments
from .common import hinted, settle, shared_dir, slices, text_bytes
from .huffman import LONGEST, STRIDE, Code, code_lengths

END = 0
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 23  # about 10 MB of bits

_WORKERS: dict[str, ByteWords] = {}


def ids_of(tokenizer: str) -> ByteWords:
    if tokenizer not in _WORKERS:
        _WORKERS[tokenizer] = ByteWords(tokenizer)
    return _WORKERS[tokenizer]


def tokenised(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, n, ids (little-endian numbers of the vocabulary's width) of every document, the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ids_of(tokenizer)
        last = np.array([end], words.dtype)
        for batch in slices(batches, 500):
            done: list[bytes] = []
            todo: list[str] = []  # whole texts, to be cut together
            size = 0

            def flush() -> None:
                done.extend(np.concatenate([ids, last]).tobytes() for ids in words.encode(todo))
                todo.clear()

            for text in batch.column(1):
                text = text.as_py() or ""
                if size + len(text) > SEGMENT:
                    flush()
                    size = 0
                if len(text) > SEGMENT:
                    done.append(np.concatenate([*[ids for part in segments(text) for ids in words.encode([part])], last]).tobytes())
                else:
                    todo.append(text)
                    size += len(text)
            flush()
            n = pa.array([len(b) // words.dtype.itemsize for b in done], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(done, pa.binary())], names=["doc_id", "n", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, ids binary")


def id_counts(ids: DataFrame, size: int, dtype: np.dtype) -> np.ndarray:
    """How often each id of the vocabulary occurs; one row per id and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in slices(batches, 200):
            data, ends = text_bytes(batch.column(0))
            sums += np.bincount(data[ends[0] : ends[-1]].view(dtype), minlength=size)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["id", "n"])

    got = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


def encoded(ids: DataFrame, code: Code, dtype: np.dtype, files: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of ``ids`` (doc_id, row, n, ids), one file per range of (doc_id, row)."""
    kind = dict(ids.dtypes)["doc_id"]
    lengths = code.lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Code(lengths)
        held: list[np.ndarray] = []
        names: list[pa.Array] = []
        first = block = size = 0

        def close() -> pa.RecordBatch:
            nonlocal first, block, size
            bits, steps = mine.encode(np.concatenate(held))
            doc_ids = pa.concat_arrays(names)
            row = [
                pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([size], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([bits], pa.binary()), pa.array([steps], pa.binary()),
            ]
            first, block, size = first + size, block + 1, 0
            held.clear()
            names.clear()
            return pa.RecordBatch.from_arrays(row, names=["block", "first", "n_ids", "doc_ids", "sizes", "bits", "steps"])

        for batch in slices(batches):
            for i, b in enumerate(batch.column(1)):
                got = np.frombuffer(b.as_buffer(), dtype)
                if held and size + len(got) > block_ids:
                    yield close()
                held.append(got)
                names.append(batch.column(0).slice(i, 1))
                size += len(got)
        if held:
            yield close()

    ranged = ids.repartitionByRange(files, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "ids")
    out = f"block long, first long, n_ids long, doc_ids array<{kind}>, sizes array<long>, bits binary, steps binary"
    return ranged.mapInArrow(run, out).select(F.spark_partition_id().alias("file"), "*")


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS) -> None:
    """Write every document's ids to the folder ``path``."""
    words = ids_of(tokenizer)
    # the row number, stable once written, tells rows of one id apart
    ids = settle(tokenised(docs, tokenizer, end).withColumn("row", F.monotonically_increasing_id()), "token-ids")
    counts = id_counts(ids, words.size, words.dtype)
    code = Code(code_lengths(counts, max(LONGEST, int(words.size - 1).bit_length())))
    spark = docs.sparkSession
    used = np.flatnonzero(code.lengths)
    spark.createDataFrame([(int(i), int(code.lengths[i])) for i in used], "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    blocks = encoded(ids, code, words.dtype, max(1, -(-int(counts.sum()) // file_ids)), block_ids)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    per = spark.read.parquet(f"{path}/blocks").groupBy("file").agg(F.sum("n_ids").alias("n_ids"))
    # one row per file of file_ids ids is all this window sees
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    per.select("file", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")).write.parquet(f"{path}/files")


def read_code(spark: SparkSession, path: str) -> Code:
    got = spark.read.parquet(f"{path}/code").toPandas()  # one row per id of the vocabulary at most
    lengths = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, np.uint8)
    lengths[got["id"].to_numpy(np.int64)] = got["bits"].to_numpy(np.uint8)
    return Code(lengths)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    files = hinted(spark.read.parquet(f"{path}/files").select("file", F.col("start").alias("before")))
    blocks = spark.read.parquet(f"{path}/blocks")
    return blocks.join(files, "file").select("doc_ids", "sizes", "bits", "steps", (F.col("before") + F.col("first")).alias("start"))


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Per document of the folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids
    (array of numbers). Blocks are decoded where they are read."""
    lengths = read_code(spark, path).lengths
    blocks = _blocks(spark, path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in slices(batches, 8):
            for doc_ids, sizes, bits, steps, start in zip(*batch.columns, strict=True):
                n = np.array(sizes.as_py(), np.int64)
                got = code.decode(bits.as_buffer().to_pybytes(), steps.as_py(), int(n.sum())).astype("<u4")
                ends = np.cumsum(n)
                crc = [zlib.crc32(got[b - size : b]) for b, size in zip(ends, n, strict=True)]
                cols = [doc_ids.values, pa.array(start.as_py() + ends - n), pa.array(n), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(got.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return blocks.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
