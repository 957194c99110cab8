"""Deterministic splits and samples by hash order, and equality checks between data sets.

Quotas are exact. Positions inside a stratum come from bucketed counts (first hash digits), so a
stratum with most of the rows is never sorted in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .prefix import number_rows

#: Hash ranges that tables are compared by.
RANGES = 256


def hash_order(key: str, seed: int) -> Column:
    """Order of a row in a seeded shuffle: md5 of seed and key, the same in other engines."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def _positions(df: DataFrame, strata: Sequence[str], key: str, seed: int) -> DataFrame:
    hashed = df.withColumn("__h", hash_order(key, seed))
    return number_rows(hashed, list(strata), ["__h", key], [F.substring("__h", 1, 4)], "__pos", "__n")


def stratified_split(df: DataFrame, label: str, key: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: 'test' for exactly ``round(frac * n)`` rows of each label, else 'train'."""
    quota = F.floor(F.lit(frac) * F.col("__n") + 0.5)
    return _positions(df, [label], key, seed).withColumn("split", F.when(F.col("__pos") <= quota, "test").otherwise("train")) \
        .drop("__h", "__pos", "__n")


def split_in_place(df: DataFrame, label: str, key: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """``stratified_split`` of rows told apart by ``key``, without moving them: rows are counted per label and hash range,
    only those of the range that holds the last test row of a label are ordered, and every row is compared with that one.
    Reads ``df`` three times, so it should be stored or near its source."""
    hashed = df.select(F.col(label).alias("__label"), hash_order(key, seed).alias("__h"), F.col(key).alias("__key")) \
        .withColumn("__range", F.substring("__h", 1, 4))
    counts = hashed.groupBy("__label", "__range").agg(F.count(F.lit(1)).alias("n"))
    of_label = Window.partitionBy("__label")
    upto = F.sum("n").over(of_label.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    quota = F.floor(F.lit(frac) * F.sum("n").over(of_label) + 0.5)
    held = counts.select("__label", "__range", "n", upto.alias("upto"), quota.alias("quota"))
    cuts = durable(held.where("upto >= quota AND upto - n < quota").select("__label", "__range", (F.col("quota") - F.col("upto") + F.col("n")).alias("need")))
    order = Window.partitionBy("__label").orderBy("__h", "__key")
    last = durable(hashed.join(cuts, ["__label", "__range"]).withColumn("__no", F.row_number().over(order)).where("__no = need")
                   .select("__label", F.struct("__h", "__key").alias("__last")))
    mine = F.struct(hash_order(key, seed).alias("__h"), F.col(key).alias("__key"))
    out = df.join(last.withColumnRenamed("__label", label), label, "left")
    return out.select(*df.columns, F.when(mine <= F.col("__last"), "test").otherwise("train").alias("split"))


def nested_split(df: DataFrame, label: str, key: str, parts: Mapping[str, tuple[float, int]],
                 test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Test split first, then further holdouts (``name -> (fraction, seed)``) out of the training rows.

    Each holdout numbers all rows inside (label, split so far) and renames the first training rows of each label; rows
    already held out keep their split. Every step is written once, so lineage grows by one pass a step."""
    out = stratified_split(df, label, key, test_frac, seed)
    for name, (frac, part_seed) in parts.items():
        quota = F.floor(F.lit(frac) * F.col("__n") + 0.5)
        taken = (F.col("split") == "train") & (F.col("__pos") <= quota)
        out = _positions(durable(out), [label, "split"], key, part_seed) \
            .withColumn("split", F.when(taken, name).otherwise(F.col("split"))).drop("__h", "__pos", "__n")
    return out


def stratified_cap(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` rows with the label shares of the whole, by exact per-label quota."""
    total = df.agg(F.count("*")).scalar()
    quota = F.floor(F.lit(float(n)) * F.col("__n") / F.greatest(total, F.lit(n)) + 0.5)
    return _positions(df, [label], key, seed).filter(F.col("__pos") <= quota).drop("__h", "__pos", "__n")


def sample_strata(df: DataFrame, label: str, key: str, wanted: Mapping[object, int], seed: int = 42,
                  check: bool = True) -> DataFrame:
    """Exactly ``wanted[level]`` rows per level without replacement. With ``check`` a short level is an
    error, found by one small count query."""
    if check:
        have = {r[0]: r[1] for r in df.filter(F.col(label).isin(list(wanted))).groupBy(label).count().collect()}
        short = {lv: have.get(lv, 0) for lv, n in wanted.items() if have.get(lv, 0) < n}
        if short:
            raise ValueError(f"too few candidates: {short}, wanted {dict(wanted)}")
    quota = F.lit(0)
    for level, n in wanted.items():
        quota = F.when(F.col(label) == F.lit(level), F.lit(n)).otherwise(quota)
    rows = df.filter(F.col(label).isin(list(wanted)))
    return _positions(rows, [label], key, seed).filter(F.col("__pos") <= quota).drop("__h", "__pos", "__n")


def content_digest(df: DataFrame, cols: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """``(range, n, one, two)``: rows per hash range and the sums of two 64-bit hashes of them, whatever their order. Sums
    are partial per task, so at most ``ranges`` rows a task are shuffled and no row of the table is."""
    one, two = F.xxhash64(*cols), F.xxhash64(F.lit(1), *reversed(cols), *cols)
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    return df.select(F.pmod(one, F.lit(ranges)).alias("range"), one.alias("h1"), two.alias("h2")).groupBy("range").agg(
        F.count(F.lit(1)).alias("n"), wide(F.col("h1")).alias("one"), wide(F.col("h2")).alias("two"))


def unequal_ranges(a: DataFrame, b: DataFrame, cols: Sequence[str], ranges: int = RANGES) -> list[int]:
    """Hash ranges in which two tables differ, at most ``ranges`` numbers."""
    x, y = (content_digest(df, cols, ranges) for df in (a, b))
    same = F.expr("x.n <=> y.n AND x.one <=> y.one AND x.two <=> y.two")
    both = x.alias("x").join(y.alias("y"), F.expr("x.range = y.range"), "full_outer").where(~same)
    return sorted(r[0] for r in both.select(F.expr("coalesce(x.range, y.range)")).collect())


def content_difference(a: DataFrame, b: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Rows (as a multiset) that only one side has: ``n_only_a``, ``n_only_b``.

    Digests of hash ranges are compared first; rows are shuffled and compared one by one in unequal ranges alone, so tables that
    agree are read and never shuffled. Digests that agree by chance (two 64-bit sums and a count) are taken as equal."""
    cols = a.columns
    differing = unequal_ranges(a, b, cols, ranges)
    if not differing:
        zero = F.lit(0).cast("bigint")
        return a.sparkSession.range(1).select(zero.alias("n_only_a"), zero.alias("n_only_b"))
    inside = F.pmod(F.xxhash64(*cols), F.lit(ranges)).isin(differing) if len(differing) < ranges else F.lit(True)
    tag = lambda df, d: df.select(*cols).where(inside).withColumn("__d", F.lit(d))
    net = tag(a, 1).unionByName(tag(b, -1)).groupBy(*cols).agg(F.sum("__d").alias("__net"))
    return net.agg(F.coalesce(F.sum(F.when(F.col("__net") > 0, F.col("__net"))), F.lit(0)).alias("n_only_a"),
                   F.coalesce(F.sum(F.when(F.col("__net") < 0, -F.col("__net"))), F.lit(0)).alias("n_only_b"))


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same columns and rows, by the digests of their hash ranges."""
    return sorted(a.columns) == sorted(b.columns) and not unequal_ranges(a, b, a.columns)


def vocabulary_agreement(a: DataFrame, b: DataFrame, key: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Two flaggers per key and category: counts, both, only one, Jaccard and exact agreement."""
    left = a.select(*key, *[F.col(f).alias(f"a_{f}") for f in flags])
    right = b.select(*key, *[F.col(f).alias(f"b_{f}") for f in flags])
    both = left.join(right, list(key), "full_outer").fillna(0)
    long = both.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("category"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in flags])).alias("s")) \
        .select("s.*")
    on = lambda c: F.count_if(c)
    x, y = F.col("a") == 1, F.col("b") == 1
    out = long.groupBy("category").agg(
        on(x).alias("n_a"), on(y).alias("n_b"), on(x & y).alias("n_both"), on(x & ~y).alias("only_a"),
        on(y & ~x).alias("only_b"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("agreement"))
    union = F.col("n_both") + F.col("only_a") + F.col("only_b")
    return out.withColumn("jaccard", F.when(union == 0, F.lit(1.0)).otherwise(F.col("n_both") / union))
