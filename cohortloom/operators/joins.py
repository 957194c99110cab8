"""Joins of a cohort with its dimensions, children and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import micros


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join. Broadcast or sort-merge, and the split of hot keys, are left to AQE."""
    return a.join(b, list(keys), "inner")


def left_lookup(df: DataFrame, dim: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keep every row, add dimension columns."""
    return df.join(dim, [key] if isinstance(key, str) else list(key), "left")


def narrow_by(df: DataFrame, child: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keep only rows that have a child record; NULL keys never match."""
    return df.join(child, [key] if isinstance(key, str) else list(key), "inner")


def left_child(df: DataFrame, agg: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Attach an already aggregated child (one row per key)."""
    return left_lookup(df, agg, key)


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def keys_in_both(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys present on both sides."""
    return a.select(*on).join(b.select(*on), list(on), "left_semi").distinct()


def within_window(events: DataFrame, anchors: DataFrame, key: str, ts: str, anchor_ts: str,
                  hours: float) -> DataFrame:
    """Events of the same key with ``anchor_ts <= ts <= anchor_ts + hours``, both ends included.

    Time is cut into slices as wide as the window and an anchor is placed in the two slices it can
    reach, so the equi-join runs on (key, slice): a hot key is spread over its slices and an event
    meets only anchors near in time."""
    width = int(hours * 3_600_000_000)
    slice_of = lambda c: F.floor(micros(c) / F.lit(width)).cast("bigint")
    left = events.withColumn("__slice", slice_of(ts))
    right = (anchors.withColumn("__first", slice_of(anchor_ts))
             .withColumn("__slice", F.explode(F.array(F.col("__first"), F.col("__first") + 1)))
             .drop("__first"))
    gap = micros(ts) - micros(anchor_ts)
    return left.join(right, [key, "__slice"], "inner").filter((gap >= 0) & (gap <= width)).drop("__slice")


def flag_by_token(df: DataFrame, tokens: str, vocab: DataFrame) -> DataFrame:
    """Vocabulary join: one row per (row, category) hit, from exploded distinct tokens and a
    ``(keyword, category)`` table."""
    return (df.withColumn("keyword", F.explode(F.array_distinct(tokens)))
            .join(vocab, "keyword", "inner").drop("keyword"))


def align_reports(a: DataFrame, b: DataFrame, key: Sequence[str], how: str = "full_outer",
                  suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Two reports side by side; rows that only one report has are kept (``left`` keeps only a's)."""
    side = lambda df, s: df.select(*key, *[F.col(c).alias(c + s) for c in df.columns if c not in key])
    return side(a, suffixes[0]).join(side(b, suffixes[1]), list(key), how)


def one_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in an explicit order. The rank limit is applied before the shuffle
    (WindowGroupLimit), so a hot key sends one row per task."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
