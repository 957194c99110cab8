"""SimHash near-duplicates by a grid join over segment bit counts.

Distinct fingerprints are embedded as points: each half of 32 bits gives 16 segments of two bits, and a coordinate is
the number of set bits (0 to 2) of its segment. Coordinates of one half differ in total by at most as many as its bits
differ, so two fingerprints within four bits are within two steps in at least one half. Every point is entered in the
unit cells at most one step away from it in each half; two points within two steps share a cell halfway. Points of a
cell are verified on the full fingerprints, and only a star per group of linked members leaves the cell, never all
pairs. Stars then meet in connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

SEED = 42
EDGES = "a long, b long"


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the shingles of ``width`` words, lower-cased A-Z; no words give 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter([hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], ">u8", len(starts))
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i:i + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(h)).tobytes(), "big", signed=True)


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(x.as_py(), width) for x in batch.column(1)], pa.int64())
            yield pa.record_batch([batch.column(0), found], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_fingerprints(width), "doc_id long, fp long")


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell keys of fingerprints and the row of each: the point and its neighbours one step away, in both halves."""
    keys, rows = [], []
    at = np.arange(len(fp))
    low = np.uint64(0x55555555)
    for half in (0, 1):
        bits = (fp.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        point = (bits & low) + ((bits >> np.uint64(1)) & low)
        tag = np.uint64(half << 32)
        keys.append(point | tag)
        rows.append(at)
        for i in range(16):
            step = np.uint64(1 << 2 * i)
            value = (point >> np.uint64(2 * i)) & np.uint64(3)
            for ok, to in ((value < 2, point + step), (value > 0, point - step)):
                keys.append(to[ok] | tag)
                rows.append(at[ok])
    return np.concatenate(keys).view(np.int64), np.concatenate(rows)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        keys, rows = cells(fp)
        yield pa.record_batch([pa.array(keys), pa.array(fp[rows])], names=["cell", "fp"])


def star_links(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) of every set of fingerprints linked within ``fp``.

    Breadth first; a visited member is compared with those not reached yet, so a dense group costs little more than
    one comparison per member."""
    rest = np.sort(fp.view(np.uint64))
    out_a, out_b = [], []
    while len(rest) > 1:
        root, todo, rest = rest[0], [rest[:1]], rest[1:]
        while todo and len(rest):
            for x in todo.pop():
                near = np.bitwise_count(rest ^ x) <= most
                if near.any():
                    found = rest[near]
                    out_a.append(found)
                    out_b.append(np.full(len(found), root, np.uint64))
                    todo.append(found)
                    rest = rest[~near]
                    if not len(rest):
                        break
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)) if out_a else (none, none)


def _link(most: int):
    def links(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of rows sorted by cell; cells with few members are compared all at once, at growing distance."""
        cuts = np.flatnonzero(np.diff(cell)) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(cell)]]))
        small = np.repeat(sizes <= 8, sizes)
        a, b = [], []
        for step in range(1, 8):
            if step >= len(cell):
                break
            same = (cell[step:] == cell[:-step]) & small[step:]
            x, y = fp[step:][same], fp[:-step][same]
            ok = np.bitwise_count((x ^ y).view(np.uint64)) <= most
            a.append(x[ok])
            b.append(y[ok])
        for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
            x, y = star_links(fp[s:s + n], most)
            a.append(x)
            b.append(y)
        none = np.zeros(0, np.int64)
        return (np.concatenate(a), np.concatenate(b)) if a else (none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fp = [], []

        def flush(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = links(cell, fp)
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held_cell.append(batch.column(0).to_numpy())
            held_fp.append(batch.column(1).to_numpy())
            size += batch.num_rows
            if size < 1 << 17:
                continue
            cell, fp = np.concatenate(held_cell), np.concatenate(held_fp)
            last = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if last:
                yield flush(cell[:last], fp[:last])
            held_cell, held_fp, size = [cell[last:]], [fp[last:]], 0
        if held_cell:
            yield flush(np.concatenate(held_cell), np.concatenate(held_fp))
    return run


def linked(points: DataFrame, most: int = 4) -> DataFrame:
    """Edges (a, b), a > b, that join all of ``points`` (distinct column fp) linked within ``most`` bits.

    Every edge joins members of one component; members of a cell hang on its smallest. The grid is built for four."""
    if most > 4:
        raise ValueError("cells one step away in each half find links of at most four bits")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = points.select("fp").mapInArrow(_cells, "cell long, fp long")
    return (keyed.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_link(most), EDGES)
            .where("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node that it reaches.

    Large-star and small-star steps in turn, on distinct edges, until the edges are stars. Smallest neighbours come
    from partial aggregation; a centre with many neighbours is a skewed join key that adaptive execution splits."""

    def least(by: DataFrame) -> DataFrame:
        return by.groupBy("u").agg(F.min("v").alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        m = least(both).select("u", F.least("m", "u").alias("m"))
        return both.where("v > u").join(m, "u").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        m = least(down)
        rest = down.join(m, "u").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return rest.unionByName(m.select(F.col("u").alias("a"), F.col("m").alias("b")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = durable(edges)
    seen = mark(edges)
    while seen[0]:
        edges = durable(small(durable(large(edges).distinct())).distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    stars = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = 4, most: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_class) for every row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and are linked like any other. component_id is the smallest doc_id of
    the component (null ids are no candidates; null if there is no other), n_class the rows with the same fingerprint.
    Repeated rows are kept. Equal fingerprints are one point; copies never become pairs."""
    rows = durable(fingerprints(docs, width))
    points = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_class")))
    reached = durable(components(linked(points, most)))
    rooted = durable(points.join(reached, points["fp"] == reached["node"], "left")
                     .select("fp", "first", "n_class", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id", "n_class")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_class")
