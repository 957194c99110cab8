"""CSV files with quoted line breaks, read by many tasks per file.

Spark's own reader gives each multi-line file to one task. Here a file is read as lines, in splits. A line break ends a
record where the number of quotation marks before it is even; an escaped mark is doubled, so it changes nothing. A first
pass counts the marks of each split, a running total over a file's splits tells with which parity each begins, and a second
pass cuts the splits into records. A record that crosses splits is put together from its pieces, at most two a split."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable
from .schemas import schema_of

SPLIT_SIZE = "spark.sql.files.maxPartitionBytes"
WHOLE, HEAD, TAIL = 0, 1, 2


@contextmanager
def _split_size(spark: SparkSession, size: int | None):
    before = spark.conf.get(SPLIT_SIZE)
    if size is not None:
        spark.conf.set(SPLIT_SIZE, str(size))
    try:
        yield
    finally:
        if size is not None:
            spark.conf.set(SPLIT_SIZE, before)


def _cut(batches: Iterator) -> Iterator:
    """Lines (file, split, odd, value) in order to pieces (file, split, kind, record).

    HEAD: what the split holds of a record begun before it. TAIL: the last record, if it does not end in the split."""
    import pyarrow as pa

    whole, head, tail = 0, 1, 2
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])

    def piece(kind: int) -> tuple:
        return (*now, kind, "\n".join(held))

    now, odd, held, kind, rows, size = None, False, [], whole, [], 0
    for batch in batches:
        for file, split, start_odd, line in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (file, split):
                if now is not None and held:
                    rows.append(piece(head if kind == head else tail))
                now, odd, held = (file, split), start_odd, []
                kind = head if odd else whole
            held.append(line)
            odd ^= line.count('"') % 2 == 1
            if not odd:
                record = piece(kind)
                rows.append(record)
                size += len(record[-1])
                held, kind = [], whole
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
    if now is not None and held:
        rows.append(piece(head if kind == head else tail))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def csv_records(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(file, split, record): the records of the CSV files at ``path`` as text, with the file and split where each begins; its
    header is the record of split 0 with ``first``.

    Quotation marks stand around fields, and doubled inside them (RFC 4180); lines end in a line feed, with or without
    carriage return. A file whose marks do not pair ends in one open record, which is kept as it is. A record is held in
    one task; splits have ``split_bytes`` at most (the session's size by default), so a file is read by as many tasks as it has
    splits. The number of marks per split is broadcast: one row per split, of which the driver plans each anyway."""
    with _split_size(spark, split_bytes):
        lines = spark.read.text(path, lineSep="\n").select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
        marks = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
        before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        parity = lines.groupBy("file", "split").agg(marks.alias("marks")).select(
            "file", "split", (F.coalesce(F.sum("marks").over(before), F.lit(0)) % 2 == 1).alias("odd"))
        parity = durable(parity)
        pieces = durable(lines.join(F.broadcast(parity), ["file", "split"]).select("file", "split", "odd", "value").mapInArrow(
            _cut, "file string, split long, kind int, record string").withColumn(
                "place", F.monotonically_increasing_id()))
    whole = pieces.where(F.col("kind") == WHOLE)
    # The split in which each piece's record begins: the last one up to here with a tail. Only keys go through the window.
    open_ = pieces.where(F.col("kind") != WHOLE)
    so_far = Window.partitionBy("file").orderBy("split", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = open_.select("file", "split", "kind").withColumn(
        "begin", F.last(F.when(F.col("kind") == TAIL, F.col("split")), ignorenulls=True).over(so_far))
    joined = (open_.join(begun, ["file", "split", "kind"]).groupBy("file", "begin")
              .agg(F.array_sort(F.collect_list(F.struct("split", "record"))).alias("parts"), F.max(
                  F.when(F.col("kind") == TAIL, F.col("place"))).alias("place"))
              .select("file", F.col("begin").alias("split"), "place", F.array_join("parts.record", "\n").alias("record")))
    found = whole.select("file", "split", "place", "record").unionByName(joined)
    first = found.groupBy("file").agg(F.min(F.struct("split", "place")).alias("least"))
    record = F.regexp_replace("record", "\r$", "")
    return found.join(first, "file").select(
        "file", "split", record.alias("record"), (F.struct("split", "place") == F.col("least")).alias("first"))


def read_notes(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True,
               split_bytes: int | None = None) -> DataFrame:
    """The rows of CSV files with quoted line breaks at ``path``, as Spark's multi-line reader gives them (escape ``"``),
    but with many tasks per file. Without a schema the discharge notes' is taken; columns go by position, and empty lines
    are skipped. The records are stored once below the checkpoint folder."""
    want = schema if schema is not None else schema_of("discharge")
    want = want if isinstance(want, T.StructType) else T.StructType.fromDDL(want)
    records = csv_records(spark, path, split_bytes)
    if header:
        records = records.where("NOT first")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in want)
    parsed = F.from_csv("record", ddl, {"escape": '"', "quote": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    return records.where("record <> ''").select(parsed.alias("r")).select("r.*")
