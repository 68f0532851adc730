"""Blocks of documents that ask, and get answers.

Some statistics need every document twice: once to gather counts over the corpus, once to use them. Rows per
occurrence would make both shuffles many times the text. Here documents lie in blocks, a table bucketed by
block id. A block asks one packed question about its distinct keys, so repeats within a block are aggregated before
the shuffle; exchange.py carries the questions to buckets of keys and the answers back. Answers meet their blocks by a
cogroup, in which the bucketed side isn't shuffled. The number of buckets, and that of the table's own, follows the
size of the input.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import kept, shared_dir

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # glibc alone has it
except (OSError, AttributeError):
    _LIBC = None

#: Bytes of text in a block and behind a bucket, about. What an operator notes of a block is many times its text, and is in memory at once.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
#: Bytes of a bucket of the table of blocks, about.
TABLE_BYTES = 256 << 20
#: Spark's own bound on a table's buckets; block ids are dealt out among them.
MOST_BUCKETS = 100_000


def release() -> None:
    """Give freed memory back: a worker lives for many blocks, and two or more share an executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def make_blocks(rows: DataFrame, text: int, name: str, block_bytes: int = BLOCK_BYTES, shape: Callable[[pa.Table], pa.Table] = lambda t: t) -> DataFrame:
    """block long, size long (bytes of text), rows binary: an Arrow stream of the rows, as `shape` makes them of a block's
    rows. text: the place of the text column. The table lies in the shared folder, bucketed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size, held = TaskContext.get().partitionId(), 0, 0, []

        def block() -> pa.RecordBatch:
            sink, table = pa.BufferOutputStream(), shape(pa.Table.from_batches(held))
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            data = zstandard.compress(sink.getvalue().to_pybytes(), 3)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["block", "size", "rows"])

        for batch in batches:
            sizes = np.diff(np.frombuffer(batch.column(text).buffers()[1], dtype=np.int32, count=batch.num_rows + 1 + batch.column(text).offset)[batch.column(text).offset :]) if batch.num_rows else np.zeros(0, np.int64)
            at, total = 0, 0
            for k, n in enumerate(sizes.tolist()):
                total += n
                if size + total >= block_bytes:
                    held.append(batch.slice(at, k + 1 - at))
                    size += total
                    yield block()
                    held, size, seq, at, total = [], 0, seq + 1, k + 1, 0
            if at < batch.num_rows:
                held.append(batch.slice(at))
                size += total
        if held:
            yield block()

    spark = rows.sparkSession
    table = f"wavedeck_{name}_{uuid.uuid4().hex}"
    known = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files read; far too large where unknown
    buckets = min(MOST_BUCKETS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), known // TABLE_BYTES if known < 1 << 60 else 0))
    made = rows.mapInArrow(run, "block long, size long, rows binary")
    path = f"{shared_dir(spark)}/wavedeck/{table}"
    kept(path, table)
    made.write.bucketBy(buckets, "block").option("compression", "none").option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def rows_of(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all()


def bucket_count(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(1, -(-(blocks.agg(F.sum("size")).head()[0] or 0) // bucket_bytes))


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed string; bytes of equal weight lie together, which packs small numbers well."""
    out = []
    for a in arrays:
        a = np.frombuffer(a, dtype=np.uint8) if isinstance(a, bytes) else np.ascontiguousarray(a)
        body = a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), body]
    return zstandard.compress(b"".join(out), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(data), 0, []
    while at < len(data):
        kind, n = np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little")
        at += 12
        body = np.frombuffer(data, dtype=np.uint8, count=n * kind.itemsize, offset=at)
        out.append(np.ascontiguousarray(body.reshape(kind.itemsize, n).T).view(kind).reshape(n) if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def delta(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def undelta(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


ASKS = "block long, bucket long, data binary"


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    block, bucket, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int64()), pa.array(data, pa.binary())], ["block", "bucket", "data"])


def ask(blocks: DataFrame, question: Callable[[int, pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """question(block, its rows) gives (bucket, packed question)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("rows")):
                yield batch_of([(block, bucket, q) for bucket, q in question(block, rows_of(data.as_py()))])
                release()

    return blocks.select("block", "rows").mapInArrow(run, ASKS)


def with_answers(blocks: DataFrame, answers: DataFrame, use: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """use(block, its rows, its answers as sent: columns bucket, data and what else they have)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return use(left.column("block")[0].as_py(), rows_of(left.column("rows")[0].as_py()), right)
        finally:
            release()

    return blocks.select("block", "rows").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
