"""Token ids as Arrow stream files of equal-length sequences with masks (fixed-size-list batches).

Documents are sorted by id, encoded, closed with an end id and laid out one after the other. Each task cuts its range
of ids into files; a file holds whole documents, so it is self-contained, and its sequences all have ``length`` ids.
The last sequence of a file is filled up and its mask says which ids are real. All batches of a file but the last hold
the same number of sequences, so they have the same size in bytes and sequence k is found by arithmetic, without
reading what stands before it (`SequenceFile`)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable
from .files import new_folder, read_files, write_files
from .tokens import Vocabulary, encoder, ids_crc32

#: Marks the end of an Arrow stream; the writer's tail.
END = b"\xff\xff\xff\xff\x00\x00\x00\x00"
INDEX = "shard int, part int, position long, doc_id long, n_tokens long, ids_crc32 long"


@dataclass(frozen=True)
class Layout:
    length: int = 2048
    batch: int = 64
    #: A file is closed by the document that brings it to this many ids.
    file_ids: int = 8 << 20


class SequenceFile:
    """Random access to a stream file held in one buffer; every array is a view of that buffer."""

    def __init__(self, content: bytes | pa.Buffer):
        self.buffer = content if isinstance(content, pa.Buffer) else pa.py_buffer(content)
        source = pa.BufferReader(self.buffer)
        self.schema = pa.ipc.read_schema(source)
        self.first = source.tell()
        meta = self.schema.metadata
        self.length, self.batch, self.n_ids, self.sequences, self.shard, self.part = (
            struct.unpack("<6q", meta[b"layout"]))
        self.doc_ids = np.frombuffer(meta[b"doc_ids"], "<i8")
        self.known = np.frombuffer(meta[b"known"], "?")
        self.doc_lengths = np.frombuffer(meta[b"doc_lengths"], "<i8")
        if self.sequences:
            pa.ipc.read_message(source)
            self.step = source.tell() - self.first

    def read(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``k``."""
        if not 0 <= k < self.sequences:
            raise IndexError(k)
        at = self.first + (k // self.batch) * self.step
        found = pa.ipc.read_record_batch(pa.ipc.read_message(pa.BufferReader(self.buffer.slice(at))), self.schema)
        row = k % self.batch
        ids = found.column(0).values.to_numpy(zero_copy_only=True)
        return ids[row * self.length:(row + 1) * self.length], found.column(1).values.slice(
            row * self.length, self.length)

    def ids(self) -> np.ndarray:
        """All real ids of the file in order."""
        parts = [b.column(0).values.to_numpy(zero_copy_only=True)
                 for b in pa.ipc.open_stream(pa.BufferReader(self.buffer))]
        return (np.concatenate(parts) if parts else np.zeros(0, "<u2"))[:self.n_ids]


def stream_bytes(docs: list[tuple[int | None, np.ndarray]], layout: Layout, dtype: np.dtype, shard: int,
                 part: int) -> bytes:
    """One file without its end mark, which the writer adds."""
    length = layout.length
    flat = np.concatenate([ids for _, ids in docs]) if docs else np.zeros(0, dtype)
    n = -(-len(flat) // length)
    padded = np.zeros(n * length, dtype)
    padded[:len(flat)] = flat
    mask = np.zeros(n * length, bool)
    mask[:len(flat)] = True
    schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))], {
        "layout": struct.pack("<6q", length, layout.batch, len(flat), n, shard, part),
        "doc_ids": np.asarray([d or 0 for d, _ in docs], "<i8").tobytes(),
        "known": np.asarray([d is not None for d, _ in docs], "?").tobytes(),
        "doc_lengths": np.asarray([len(i) for _, i in docs], "<i8").tobytes()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        for i in range(0, n, layout.batch):
            cut = slice(i * length, min(i + layout.batch, n) * length)
            writer.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(padded[cut]), length),
                pa.FixedSizeListArray.from_arrays(pa.array(mask[cut]), length)], schema=schema))
    return sink.getvalue().to_pybytes()[:-len(END)]


def write_token_files(docs: DataFrame, doc_id: str, text: str, folder: str, vocabulary: Vocabulary, end_id: int,
                      layout: Layout = Layout()) -> None:
    """Encode ``text`` of every row, null as empty, and write the files of all rows in ascending ``doc_id``.

    Rows without id come first; rows of one id are ordered by the hash of their text, so a hot id is spread over
    ranges. Other columns are ignored. No rows give no files."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .withColumn("tie", F.xxhash64("text")))
    ranged = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        shard = TaskContext.get().partitionId()
        end = np.asarray([end_id], enc.dtype)
        held: list[tuple[int | None, np.ndarray]] = []
        size = part = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, enc.encode(x.as_py() for x in batch.column(1))):
                held.append((key, np.concatenate([ids, end])))
                size += len(ids) + 1
                if size >= layout.file_ids:
                    yield pa.record_batch([pa.array([stream_bytes(held, layout, enc.dtype, shard, part)], pa.binary())],
                                          names=["content"])
                    held, size, part = [], 0, part + 1
        if held:
            yield pa.record_batch([pa.array([stream_bytes(held, layout, enc.dtype, shard, part)], pa.binary())],
                                  names=["content"])

    write_files(ranged.select("doc_id", "text").mapInArrow(write, "content binary"), "content", folder, END)


def _read_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            f = SequenceFile(content.as_buffer())
            ids, at = f.ids(), np.concatenate([[0], np.cumsum(f.doc_lengths)])
            n = len(f.doc_ids)
            yield pa.record_batch([
                pa.array(np.full(n, f.shard, np.int32)), pa.array(np.full(n, f.part, np.int32)), pa.array(at[:-1]),
                pa.array(f.doc_ids, mask=~f.known), pa.array(f.doc_lengths),
                pa.array([ids_crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())],
                names=["shard", "part", "position", "doc_id", "n_tokens", "ids_crc32"])


def _running(col: str, window: Window) -> Column:
    return F.coalesce(F.sum(col).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files below ``folder``; ``start`` counts the ids
    of all documents before it. Only per-file and per-task totals meet in windows."""
    docs = durable(read_files(spark, folder).mapInArrow(_read_index, INDEX))
    files = docs.groupBy("shard", "part").agg(F.sum("n_tokens").alias("n"))
    shards = files.groupBy("shard").agg(F.sum("n").alias("n"))
    before = shards.select("shard", _running("n", Window.orderBy("shard")).alias("shard_start"))
    files = files.select("shard", "part", _running("n", Window.partitionBy("shard").orderBy("part")).alias("file_start"))
    return (docs.join(files.join(before, "shard"), ["shard", "part"])
            .select("doc_id", (F.col("shard_start") + F.col("file_start") + F.col("position")).alias("start"),
                    "n_tokens", "ids_crc32"))


def token_index(docs: DataFrame, vocabulary: Vocabulary, end_id: int = 2, layout: Layout = Layout()) -> DataFrame:
    """Write the token files of ``docs`` (doc_id, text) below the shared folder and describe them from what was read
    back. No documents give no rows."""
    folder = new_folder(docs.sparkSession)
    write_token_files(docs, "doc_id", "text", folder, vocabulary, end_id, layout)
    return read_token_files(docs.sparkSession, folder)
