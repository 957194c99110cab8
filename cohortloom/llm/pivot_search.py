"""Exact top-k by inner product with a table of distances to pivots.

Vectors become whole numbers. With one more coordinate, sqrt(M - |x|^2) for a candidate (M the largest squared norm) and 0
for a query, the largest inner product is the smallest distance: d(q, x)^2 = |q|^2 + M - 2 q.x. The pivot table keeps every
candidate's distances to the pivots, so by the triangle inequality max over pivots of |d(q, p) - d(x, p)| bounds d(q, x) from
below. A task meets its candidates block by block and, for each query, evaluates them in the order of that bound until it
is above the distance of the k-th best so far. Queries travel to the tasks in groups of bounded size; each group is one
pass over the stored candidates, without a shuffle of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

EXACT = 1 << 53
HITS = "query long, vec_id long, score long, own boolean"


def integers(vectors: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of every component as float64, shorter vectors filled with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(vectors), dims))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(vectors)), sizes), at] = flat
    return out


def scores(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of rows; ``most`` bounds the sum of absolute products. Beyond a long they are held at its ends."""
    if most < 1 << 24:
        return (x.astype(np.float32, copy=False) @ y.T.astype(np.float32, copy=False)).astype(np.int64)
    if most < EXACT:
        return (x @ y.T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in x.tolist()], object) @ np.array(
        [[int(v) for v in r] for r in y.tolist()], object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Pivots:
    """Pivots as candidates, and the largest squared norm of all."""

    def __init__(self, points: np.ndarray, largest: float):
        self.points, self.largest = points, largest
        self.extra = np.sqrt(np.maximum(0, largest - (points ** 2).sum(1)))

    def of_candidates(self, x: np.ndarray) -> np.ndarray:
        own = (x ** 2).sum(1)
        lifted = np.sqrt(np.maximum(0, self.largest - own))
        dot = x @ self.points.T + lifted[:, None] * self.extra
        return np.sqrt(np.maximum(0, 2 * (self.largest - dot)))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (q ** 2).sum(1)[:, None] + self.largest - 2 * q @ self.points.T))


def stored_kind(largest: float) -> str:
    """The smallest type that holds every component of vectors with squared norms up to ``largest``."""
    return "<i2" if largest < 1 << 30 else "<i4" if largest < 1 << 62 else "<f8"


def spread_out(sample: np.ndarray, largest: float, count: int) -> np.ndarray:
    """Up to ``count`` rows of ``sample``, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen, nearest = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        nearest = np.minimum(nearest, Pivots(sample[chosen[-1:]], largest).of_candidates(sample)[:, 0])
        chosen.append(int(nearest.argmax()))
        if nearest[chosen[-1]] == 0:
            chosen.pop()
            break
    return sample[chosen]


class Best:
    """The k best (score, smaller id first) of each query so far; ties at the end are kept until they are beaten."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = [np.zeros(0, np.int64)] * len(floor)
        self.vec = [np.zeros(0, np.int64)] * len(floor)
        self.own = [np.zeros(0, bool)] * len(floor)

    def add(self, i: int, score: np.ndarray, vec: np.ndarray, own: np.ndarray) -> None:
        s, v, o = (np.concatenate(p) for p in ((self.score[i], score), (self.vec[i], vec), (self.own[i], own)))
        by = np.lexsort((v, -s))[:self.k] if s.min() > -(1 << 63) else np.lexsort((v, -s.astype(object)))[:self.k]
        self.score[i], self.vec[i], self.own[i] = s[by], v[by], o[by]
        if len(by) == self.k:
            self.floor[i] = max(self.floor[i], self.score[i][-1])


def _search(group, k: int, first: int):
    """Candidates (vec_id, x, table) against a group of queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = group.value
        q, norm, far, most, pivots = g["q"], g["norm"], g["far"], g["most"], g["pivots"]
        dims = q.shape[1]
        low = np.full(len(q), -(1 << 63), np.int64)
        if len(g["pilot"]) >= k:  # the k-th best of a few rows is a threshold from the start
            for a in range(0, len(q), 1024):
                low[a:a + 1024] = np.partition(scores(q[a:a + 1024], g["pilot"], most), -k, axis=1)[:, -k]
        best = Best(k, low)
        slack = 1e-4 * max(1.0, float(np.sqrt(pivots.largest)))
        kind = np.float32 if most < 1 << 24 else np.float64
        q = q.astype(kind)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vec = batch.column(0).to_numpy()
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), g["stored"]).reshape(n, dims).astype(kind)
            table = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(n, -1).T.copy()
            for i in range(len(q)):
                bound = np.abs(table[0] - far[i, 0])
                for p in range(1, len(table)):
                    np.maximum(bound, np.abs(table[p] - far[i, p]), out=bound)
                step, done = first, -1.0
                while True:
                    reach = np.sqrt(max(0.0, norm[i] + pivots.largest - 2.0 * best.floor[i])) + slack
                    rest = bound <= reach
                    if done >= 0:
                        rest &= bound > done
                    left = int(np.count_nonzero(rest))
                    if not left:
                        break
                    if left > step:
                        cut = np.partition(bound[rest], step)[step]
                        rest &= bound <= cut
                        done = float(cut)
                    rows = np.flatnonzero(rest)
                    if 2 * len(rows) > n:
                        s = scores(x, q[i:i + 1], most)[rows, 0]
                    else:
                        s = scores(x[rows], q[i:i + 1], most)[:, 0]
                    good = s >= best.floor[i]
                    if good.any():
                        rows, s = rows[good], s[good]
                        own = vec[rows] == g["id"][i]
                        own[own] = (x[rows[own]] == q[i]).all(1)
                        best.add(i, s, vec[rows], own)
                    if left <= step:
                        break
                    step *= 16
        count = np.asarray([len(s) for s in best.score])
        for a in range(0, len(q), 4096):
            b = min(len(q), a + 4096)
            if count[a:b].sum():
                yield pa.record_batch([
                    pa.array(np.repeat(g["number"][a:b], count[a:b])), pa.array(np.concatenate(best.vec[a:b])),
                    pa.array(np.concatenate(best.score[a:b])), pa.array(np.concatenate(best.own[a:b]))],
                    names=["query", "vec_id", "score", "own"])
    return run


def _prepared(dims: int, scale: float, pivots, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), dims, scale)
            table = pivots.value.of_candidates(x).astype(np.float32)
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()),
                                   pa.array([r.tobytes() for r in table], pa.binary())], names=["vec_id", "x", "far"])
    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64, vec_id: str = "vec_id",
          embedding: str = "embedding", pivots: int = 24, sample: int = 1024, group_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest integer inner product for each row whose id is divisible by
    ``every``, among all rows but itself; ties go to the smaller id.

    Components count as floor(scale * x). Rows without id or vector, or with a null or non-finite component, take no part.
    Shorter vectors are filled with zeros. A repeated row is a query, and a candidate, of its own; equal queries give equal
    rows. Scores beyond a long are held at its ends. An empty table gives no rows; other columns are ignored.

    Pivots come from at most ``sample`` rows; they and the pilot rows only change the speed. Queries are broadcast in groups
    of at most ``group_bytes``, one pass over the candidates each; a task returns at most k + 1 rows for a query."""
    spark = vectors.sparkSession
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole)
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + F.pow(F.floor(scale * c).cast("double"), 2.0))
    found = rows.agg(F.max(F.size("v")), F.max(norm)).first()
    dims, largest = max(1, found[0] or 0), float(found[1] or 0)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    pilot = integers(picked.column("v").combine_chunks(), dims, scale)
    chosen = Pivots(spread_out(pilot, largest, pivots), largest)
    shared = spark.sparkContext.broadcast(chosen)
    kind = stored_kind(largest)
    stored = durable(rows.mapInArrow(_prepared(dims, scale, shared, kind), "vec_id long, x binary, far binary"))
    shared.destroy()

    queries = durable(stored.where(F.col("vec_id") % every == 0).select("vec_id", "x")
                      .withColumn("query", F.monotonically_increasing_id()))
    each = 8 * dims + 4 * pivots + 32
    groups = max(1, -(-queries.count() * each // group_bytes))
    parts = []
    for n in range(groups):
        mine = queries.where(F.pmod(F.xxhash64("query"), F.lit(groups)) == n).toArrow()
        if not mine.num_rows:
            continue
        q = np.frombuffer(b"".join(mine.column("x").to_pylist()), kind).reshape(mine.num_rows, dims).astype(np.float64)
        group = spark.sparkContext.broadcast({
            "q": q, "id": mine.column("vec_id").to_numpy(), "number": mine.column("query").to_numpy(),
            "norm": (q ** 2).sum(1), "far": chosen.of_queries(q).astype(np.float32), "most": largest, "pivots": chosen,
            "pilot": pilot, "stored": kind})
        # |q.x| and all its partial sums are at most |q| |x|, so the largest squared norm bounds them
        parts.append(durable(stored.mapInArrow(_search(group, k + 1, 256), HITS)))
        group.destroy()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return _ranked(hits, queries, k)


def _ranked(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k + 1 best of each query without one row that is the query itself, if it is among them."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    near = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    mine = F.min(F.when(F.col("own"), F.col("n"))).over(Window.partitionBy("query"))
    near = near.withColumn("mine", F.coalesce(mine, F.lit(k + 2)))
    near = near.where("n <> mine").withColumn("rank", (F.col("n") - (F.col("n") > F.col("mine")).cast("int")).cast("int"))
    names = queries.select("query", F.col("vec_id").alias("query_id"))
    return near.where(F.col("rank") <= k).join(names, "query").select("query_id", "rank", "vec_id", "score")
