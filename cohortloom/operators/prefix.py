"""Exclusive prefix totals that never put a whole group into one task.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a hot key to one task. Here the
order axis is cut into buckets of several levels: totals per coarse bucket are carried forward over the few of a key,
totals per finer bucket over those of its coarse one, and the exact running total is taken inside the finest. So a key
with a third of all rows is spread over its buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import micros

_COMBINE = {"sum": F.sum, "max": F.max}


def with_prior(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
               buckets: Sequence[Column], measures: Mapping[str, tuple[str, str]],
               totals_of: Mapping[str, str] | None = None) -> DataFrame:
    """Add, per measure ``name: (kind, column)``, its total over the rows of the same keys that come
    strictly earlier in ``order`` (NULL when there is none). ``buckets`` are coarse-to-fine
    functions of the order that never decrease along it; ``order`` must be total within a key, and keys
    must not be NULL.
    ``totals_of`` (``name -> measure``) also adds a measure's total over the whole key; it comes from the
    bucket table that is joined anyway, so no join on a few-valued key is needed."""
    levels = [f"__b{i}" for i in range(len(buckets))]
    base = df.withColumns(dict(zip(levels, buckets)))
    out = base.select(
        "*",
        *[_COMBINE[kind](col).over(
            Window.partitionBy(*keys, *levels).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, -1)).alias(f"__local_{name}")
          for name, (kind, col) in measures.items()])
    carried = None
    for depth in range(1, len(levels) + 1):
        group = [*keys, *levels[:depth]]
        totals = base.groupBy(*group).agg(
            *[_COMBINE[kind](col).alias(name) for name, (kind, col) in measures.items()])
        ahead = (Window.partitionBy(*group[:-1]).orderBy(group[-1])
                 .rowsBetween(Window.unboundedPreceding, -1))
        whole = [_COMBINE[measures[m][0]](m).over(Window.partitionBy(*keys)).alias(name)
                 for name, m in (totals_of or {}).items()] if depth == 1 else []
        carry = totals.select(
            *group, *[_COMBINE[kind](name).over(ahead).alias(f"__carry{depth}_{name}")
                      for name, (kind, _) in measures.items()], *whole)
        # the small bucket tables meet first; the rows join once, on the partitioning they already have
        carried = carry if carried is None else carry.join(carried, group[:-1], "left")
    out = out.join(carried, [*keys, *levels], "left")
    parts = lambda name: [F.col(f"__local_{name}"),
                          *[F.col(f"__carry{d}_{name}") for d in range(1, len(levels) + 1)]]
    return out.select(
        *df.columns,
        *[_merge(kind, parts(name)).alias(name) for name, (kind, _) in measures.items()],
        *(totals_of or {}))


def _merge(kind: str, parts: Sequence[Column]) -> Column:
    if kind == "max":
        return F.greatest(*parts) if len(parts) > 1 else parts[0]
    total = parts[0]
    for extra in parts[1:]:
        total = F.when(total.isNull(), extra).when(extra.isNull(), total).otherwise(total + extra)
    return total


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                buckets: Sequence[Column], name: str = "row_no", size: str | None = None) -> DataFrame:
    """1-based position of each row inside its key along ``order``; ``size`` names the key's row count."""
    one = df.withColumn("__one", F.lit(1).cast("bigint"))
    return (with_prior(one, keys, order, buckets, {name: ("sum", "__one")}, {size: name} if size else None)
            .withColumn(name, F.coalesce(F.col(name), F.lit(0)) + 1).drop("__one"))


def time_buckets(ts: str, seconds: int = 300, days: int = 30) -> list[Column]:
    """Two bucket levels of a timestamp column: ``days`` long, then ``seconds`` long. Totals of one key are carried over
    about a hundred coarse buckets in ten years, those of one coarse bucket over a few thousand fine ones; the
    fine ones cut up a key that holds a third of all rows. All three bounds come from the calendar, not the data."""
    at = lambda s: F.floor(micros(ts) / F.lit(s * 1_000_000)).cast("bigint")
    return [at(days * 86_400), at(seconds)]


def value_buckets(col: str | Column) -> list[Column]:
    """Two bucket levels for any double: both follow the (weakly monotone) signed logarithm, so they
    need no pass over the data and give the same cut in every task."""
    c = F.col(col) if isinstance(col, str) else col
    squash = F.signum(c) * F.log1p(F.abs(c))
    return [F.floor(squash * 1024).cast("bigint"), F.floor(squash * (1024 * 4096)).cast("bigint")]


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """One row per column with exact, linearly interpolated quantiles, ``probs`` naming them.

    Values are never shuffled as a whole: each pass counts rows per bucket, finds the few buckets that hold a wanted
    rank and hands on only their rows. The last pass places the distinct values of the finest buckets."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "column", "value") \
             .filter("value IS NOT NULL AND NOT isnan(value)")
    levels = ["__b0", "__b1"]
    rows = long.withColumns(dict(zip(levels, value_buckets("value"))))
    ranks = [(f"__{side}_{name}", fn(F.lit(p) * (F.col("total") - 1)))
             for name, p in probs.items() for side, fn in (("lo", F.floor), ("hi", F.ceil))]
    end = F.col("before") + F.col("n")
    holds = lambda pos: (F.col("before") <= pos) & (pos < end)
    some = F.lit(False)
    for _, pos in ranks:
        some = some | holds(pos)

    wanted, kept, base = None, rows, F.lit(0).cast("bigint")
    for depth in (1, 2, 3):
        group = ["column", *levels[:depth - 1]]
        at = [*levels, "value"][depth - 1]
        carry = [] if wanted is None else ["__base", "total"]
        counts = kept.groupBy(*group, at, *carry).agg(F.count("*").alias("n"))
        w = Window.partitionBy(*group).orderBy(at)
        before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("n").over(Window.partitionBy(*group)) if wanted is None else F.col("total")
        placed = counts.select(*group, at, "n", (base + before).alias("before"), total.alias("total"))
        if depth < 3:
            # at most two rows per column and quantile, so sending them to every task is safe at any size
            wanted = placed.filter(some).select(*group, at, F.col("before").alias("__base"), "total")
            kept, base = rows.join(F.broadcast(wanted), [*group, at]), F.col("__base")
    picks = [F.max(F.when(holds(pos), F.col("value"))).alias(name) for name, pos in ranks]
    out = placed.groupBy("column", "total").agg(*picks)
    return out.select("column", *[
        (F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}"))
         * (F.lit(p) * (F.col("total") - 1) - F.floor(F.lit(p) * (F.col("total") - 1)))).alias(name)
        for name, p in probs.items()])
