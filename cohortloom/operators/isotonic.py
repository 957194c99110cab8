"""Isotonic regression in pieces: pooled blocks of neighbouring score ranges are pooled again, level by level.

Pooling adjacent violators is associative: blocks of a range stand for its points, as (weight, sum) pairs in order of
score. So every range is pooled in its own task, and ``FAN`` neighbours meet at a time until one range is left. The last
level holds the blocks alone: with 0/1 labels their rates are different fractions whose denominators add up to at most
the number of rows, so n rows give no more than about n^(2/3) blocks, a million for a thousand million rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .prefix import value_buckets, with_prior

FAN = 16
#: Most blocks of a map that is sent to every task; a larger one is met by score ranges.
SENT_BLOCKS = 100_000
_CHUNK = 1 << 16


def fit_blocks(rows: DataFrame, score: str, label: str, weight: str | None = None, by: Sequence[str] = (),
               ranges: int = 64) -> DataFrame:
    """``(*by, lo, hi, value, weight)``: the blocks of the least-squares map that never falls, per group of ``by``.

    Rows without a score, label or positive weight (null or NaN) are left out; equal scores are one point. Groups need no
    balance, as ranges are cut over all points together. No rows give no blocks."""
    number = lambda c: F.col(c).cast("double")
    points = rows.select(*by, number(score).alias("lo"), number(label).alias("__y"),
                         (number(weight) if weight else F.lit(1.0)).alias("weight"))
    points = points.dropna(subset=["lo", "__y", "weight"]).where("weight > 0") \
        .groupBy(*by, "lo").agg(F.sum("weight").alias("weight"), F.sum(F.col("__y") * F.col("weight")).alias("total"))
    level = points.select(*by, "lo", F.col("lo").alias("hi"), "weight", "total").repartitionByRange(ranges, *by, "lo") \
        .withColumn("part", F.spark_partition_id())
    while True:
        level = level.sortWithinPartitions(*by, "part", "lo").mapInArrow(_pool([*by, "part"]), level.schema)
        if ranges == 1:
            return level.select(*by, "lo", "hi", (F.col("total") / F.col("weight")).alias("value"), "weight")
        ranges = -(-ranges // FAN)
        level = level.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).repartition(*by, "part")


def _pool(group: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, blocks = None, None, []

        def rows() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(blocks), _CHUNK):
                some = blocks[at:at + _CHUNK]
                columns = dict(zip(group, ([g] * len(some) for g in now or ())))
                columns |= dict(zip(("lo", "hi", "weight", "total"), zip(*some)))
                yield pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

        for batch in batches:
            schema = batch.schema
            keys = zip(*(batch.column(g).to_pylist() for g in group))
            values = zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "weight", "total")))
            for key, (lo, hi, weight, total) in zip(keys, values):
                if key != now:
                    yield from rows()
                    now, blocks = key, []
                while blocks and blocks[-1][3] * weight >= total * blocks[-1][2]:
                    before = blocks.pop()
                    lo, weight, total = before[0], before[2] + weight, before[3] + total
                blocks.append((lo, hi, weight, total))
        yield from rows()
    return run


@dataclass(frozen=True)
class IsotonicMap:
    """A fitted map, stored as its blocks ``(lo, hi, value, ...)`` of one group."""

    blocks: DataFrame

    def _edges(self, limit: int) -> tuple[list[float], list[float]] | None:
        rows = self.blocks.select("lo", "hi", "value").orderBy("lo").limit(limit + 1).collect()
        if len(rows) > limit:
            return None
        edges = [(x, r["value"]) for r in rows for x in dict.fromkeys((r["lo"], r["hi"]))]
        return [x for x, _ in edges], [v for _, v in edges]

    @property
    def boundaries(self) -> list[float]:
        return self._checked()[0]

    @property
    def predictions(self) -> list[float]:
        return self._checked()[1]

    def _checked(self) -> tuple[list[float], list[float]]:
        edges = self._edges(SENT_BLOCKS)
        if edges is None:
            raise ValueError(f"more than {SENT_BLOCKS} blocks: read them from the table")
        return edges

    def apply(self, df: DataFrame, score: str, out: str, sent_blocks: int = SENT_BLOCKS) -> DataFrame:
        """``df`` with the map's value: level inside a block and beyond the ends, straight between blocks. Null and NaN
        scores, and all scores of a map without blocks, give null."""
        edges = self._edges(sent_blocks)
        if edges is None:
            return self._apply_by_range(df, score, out)
        if not edges[0]:
            return df.withColumn(out, F.lit(None).cast("double"))
        xs, values = (np.array(e) for e in edges)

        @F.pandas_udf("double")
        def place(s: pd.Series) -> pd.Series:
            return pd.Series(np.interp(s.to_numpy(float, na_value=np.nan), xs, values)).where(s.notna().to_numpy())
        return df.withColumn(out, place(F.col(score).cast("double")))

    def _apply_by_range(self, df: DataFrame, score: str, out: str) -> DataFrame:
        """Scores and edges meet in buckets of the score: the last edge before a score is a running maximum."""
        ahead = Window.orderBy("__x")  # over the bounded number of edges
        edges = self.blocks.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("__x"), F.col("value").alias("__v"))
        edges = edges.select("__x", F.struct("__x", F.col("__v").alias("v"), F.lead("__x").over(ahead).alias("x2"), F.lead("__v").over(ahead).alias("v2"))
                         .alias("__edge"))
        first = self.blocks.agg(F.min_by("value", "lo")).first()[0]
        scored = df.withColumn("__x", F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")))
        both = scored.unionByName(edges, allowMissingColumns=True).withColumn("__row", F.col("__edge").isNull())
        met = with_prior(both, [], ["__x", "__row"], value_buckets("__x"), {"__at": ("max", "__edge")}).where("__row")
        at = lambda f: F.col("__at")[f]
        between = at("v") + (at("v2") - at("v")) * (F.col("__x") - at("__x")) / (at("x2") - at("__x"))
        value = F.when(F.col("__x").isNull(), None).when(F.col("__at").isNull(), first).otherwise(F.coalesce(between, at("v")))
        return met.withColumn(out, value).select(*df.columns, out)


def fit_map(rows: DataFrame, score: str, label: str, weight: str | None = None, ranges: int = 64) -> IsotonicMap:
    return IsotonicMap(durable(fit_blocks(rows, score, label, weight, ranges=ranges)))
