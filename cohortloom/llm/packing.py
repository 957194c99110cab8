"""Hierarchical best-fit packing of token pieces into sequences.

Every task encodes its documents, cuts only those longer than a sequence, and best-fits its pieces locally, longest
first. Bins with no room that any other open bin could use are done; the open ones are items of the next round, where
eight groups merge into one, until one group is left or a round changes nothing. A group never holds more than
``group_bins`` bins, so a task's memory is bounded at every size of the input."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .tokens import Vocabulary, encoder, ids_crc32

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def best_fit(sizes: Sequence[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every item, best-fit decreasing; ties in the given order.

    The bits of one integer tell which amounts of room occur, so the tightest bin is found without a search."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    present = opened = 0
    for i in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        size = int(sizes[i])
        fits = present >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                present &= ~(1 << left)
        else:
            left, b, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = b, capacity - left
        if left > size:
            room[left - size].append(b)
            present |= 1 << (left - size)
    return bins, offsets


def _pack_batches(vocabulary: Vocabulary, end_id: int, capacity: int, group_pieces: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.asarray([end_id], enc.dtype)
        names = [f.split()[0] for f in PIECES.split(", ")]
        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal base, rows
            bins, offsets = best_fit([r[3] for r in rows], capacity)
            lengths = np.asarray([r[3] for r in rows], np.int64)
            fill = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            out = pa.record_batch([*columns, pa.array(bins + base), pa.array(offsets), pa.array(fill)], names=names)
            base += int(bins.max()) + 1
            rows = []
            return out

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, enc.encode(x.as_py() for x in batch.column(1))):
                ids = np.concatenate([ids, end])
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start:start + capacity]
                    rows.append((key, piece, start, len(cut), ids_crc32(cut)))
                if len(rows) >= group_pieces:
                    yield flush()
        if rows:
            yield flush()
    return pack


def _merge(capacity: int):
    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["root", "shift", "bin"], ignore_index=True)
        roots = part.groupby("root", sort=True)["fill"].sum()
        bins, offsets = best_fit(roots.to_numpy(), capacity)
        first = pd.Series(roots.index.to_numpy(), index=bins)[offsets == 0]
        place = pd.DataFrame({"to": first.loc[bins].to_numpy(), "by": offsets,
                              "total": np.bincount(bins, weights=roots.to_numpy()).astype(np.int64)[bins]}, index=roots.index)
        at = place.loc[part["root"]]
        part["root"], part["total"] = at["to"].to_numpy(), at["total"].to_numpy()
        part["shift"] = part["shift"] + at["by"].to_numpy()
        return part
    return merge


def merge_underfull(bins: DataFrame, capacity: int, fan: int = 8, group_bins: int = 16384) -> DataFrame:
    """Where each underfull bin (bin, fill) ends: (bin, root, shift) for those with a partner.

    A round keeps a bin in play only if the emptiest open bin could still join it, counted over all of them."""
    schema = "bin long, fill long, root long, shift long, total long, part long"
    play = bins.select("bin", "fill", F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"),
                       F.col("fill").alias("total"))
    done: list[DataFrame] = []
    groups: int | None = None
    while True:
        play = durable(play)
        n, least = play.agg(F.count_distinct("root"), F.min("total")).first()
        if n <= 1:
            break
        closed = F.col("total") + least > capacity
        done.append(play.where(closed))
        play = play.where(~closed)
        n = play.agg(F.count_distinct("root")).first()[0]
        if n <= 1:
            break
        wanted = max(1, -(-n // group_bins))
        groups = max(wanted, -(-n // 1024)) if groups is None else max(wanted, -(-groups // fan))
        play = durable(play.withColumn("part", F.pmod(F.xxhash64("root"), F.lit(groups)))
                       .groupBy("part").applyInPandas(_merge(capacity), schema).drop("part"))
        left = play.agg(F.count_distinct("root")).first()[0]
        if groups == 1 or groups == wanted and left > 0.95 * n:
            break
    for d in done:
        play = play.unionByName(d)
    return play.where("root <> bin OR shift <> 0 OR total <> fill").select("bin", "root", "shift")


def pack(docs: DataFrame, vocabulary: Vocabulary, end_id: int = 0, capacity: int = 2048,
         group_pieces: int = 1 << 16) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with their places: (doc_id, piece, start, length, ids_crc32, sequence_id,
    offset).

    Null texts count as empty, so each document has at least its end id; rows that repeat a doc_id are packed each.
    Equal lengths are placed in row order. Other columns are ignored; no documents give no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    pieces = durable(rows.mapInArrow(_pack_batches(vocabulary, end_id, capacity, group_pieces), PIECES))
    moved = merge_underfull(pieces.where(f"offset = 0 AND fill < {capacity}").select("bin", "fill"), capacity)
    return pieces.join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("root", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
