"""Per-key aggregates, distributions and fitted statistics.

Everything is expressed through partial (map-side) aggregates with small buffers: counts, sums,
min/max and structs. No per-key list or value map is built."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .prefix import exact_quantiles


def first_by(df: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Earliest non-NULL value of each column per key; equal times -> smallest value."""
    return df.groupBy(*key).agg(*[
        F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(ts), F.col(c)))).getField(c).alias(c) for c in cols])


def count_by(df: DataFrame, key: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias(name))


def any_flags(df: DataFrame, key: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """OR of 0/1 flags per key."""
    return df.groupBy(*key).agg(*[F.coalesce(F.max(f), F.lit(0)).cast("int").alias(f) for f in flags])


def union_sets(a: DataFrame, b: DataFrame, key: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """OR of the flags of two sources per key."""
    cols = [*key, *flags]
    return any_flags(a.select(*cols).unionByName(b.select(*cols)), key, flags)


def mode_by(df: DataFrame, key: Sequence[str], col: str, name: str | None = None) -> DataFrame:
    """Most frequent value per key, smallest value on ties."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*key, col).agg(F.count("*").alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("neg"), F.col(col).alias("value")))
    return counts.groupBy(*key).agg(best.getField("value").alias(name or col))


def coverage(df: DataFrame, flags: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows for which each condition holds."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[
        F.avg(F.coalesce(c.cast("int"), F.lit(0))).alias(name) for name, c in flags.items()])


def value_distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows per level with their percentage, most frequent first."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    total = counts.select(F.sum("n")).scalar()
    return counts.withColumn("pct", 100.0 * F.col("n") / total).orderBy(F.desc("n"), F.asc(col))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact distinct counts, one row per column, from one scan: (column, value) pairs are de-duplicated across tasks,
    then counted. Values are told apart by their text, which is exact for every type with a faithful cast."""
    pairs = df.unpivot([], [F.col(c).cast("string").alias(c) for c in cols], "column", "value").distinct()
    return pairs.groupBy("column").agg(F.count("value").alias("n_distinct"))


def summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, exact median, min and max, one row per column."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "column", "value")
    basic = long.groupBy("column").agg(F.avg("value").alias("mean"), F.min("value").alias("min"),
                                       F.max("value").alias("max"))
    return basic.join(exact_quantiles(df, cols, {"median": 0.5}), "column")


# --- token priors ----------------------------------------------------------------------------------

def _words(text: str) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: F.length(w) > 0)


def fit_token_prior(df: DataFrame, text: str, label: str, min_count: int = 20) -> DataFrame:
    """Mean label per word over all its occurrences (repeats in a row count); words of one character
    or with fewer than ``min_count`` occurrences are left out."""
    words = df.select(F.explode(_words(text)).alias("token"), F.col(label).alias("__y")) \
        .filter(F.length("token") > 1)
    return (words.groupBy("token").agg(F.avg("__y").alias("prior"), F.count("__y").alias("n"))
            .filter(F.col("n") >= min_count))


def apply_token_prior(df: DataFrame, key: str, text: str, prior: DataFrame, neutral: float = 3.0) -> DataFrame:
    """Min, mean, max and population deviation of the known word priors per row; no known word ->
    neutral, neutral, neutral, 0. The prior table is stored, so words meet it by its known size, and only
    the totals per row and task are shuffled."""
    known = durable(prior.select("token", "prior"))
    p = F.col("prior")
    stats = df.select(key, F.explode(_words(text)).alias("token")).join(known, "token").groupBy(key).agg(
        F.min(p).alias("__min"), F.max(p).alias("__max"), F.count(p).alias("__k"), F.sum(p).alias("__s"), F.sum(p * p).alias("__q"))
    mean = F.col("__s") / F.col("__k")
    spread = F.sqrt(F.greatest(F.col("__q") / F.col("__k") - mean * mean, F.lit(0.0)))
    return df.select(key).join(stats, key, "left").select(
        key,
        F.coalesce("__min", F.lit(neutral)).alias("min_severity_prior"),
        F.coalesce(mean, F.lit(neutral)).alias("mean_severity_prior"),
        F.coalesce("__max", F.lit(neutral)).alias("max_severity_prior"),
        F.coalesce(spread, F.lit(0.0)).alias("std_severity_prior"))


# --- standardisation and class weights ---------------------------------------------------------------

def fit_standardizer(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows ``(column, mean, std)`` with the population deviation; a constant column gets std 1."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "column", "value")
    fitted = long.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return fitted.withColumn("std", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")))


def standardize(df: DataFrame, fitted: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """z-scores from a fitted table; a missing value counts as the mean, so its z-score is 0. The fitted
    table (one row per column) is read once, as a single scalar subquery."""
    table = fitted.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("mean", "std"))))).scalar()
    ready = df.withColumn("__fit", table)
    at = lambda c, what: F.try_element_at("__fit", F.lit(c)).getField(what)
    return ready.withColumns({
        c + suffix: F.coalesce((F.col(c).cast("double") - at(c, "mean")) / at(c, "std"), F.lit(0.0))
        for c in cols}).drop("__fit")


def class_weights(df: DataFrame, label: str, p: float = 0.5, boost: Mapping[object, float] | None = None) -> DataFrame:
    """Weight ``(N / (K * n_c)) ** p`` per class, with optional factors for some classes."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    weight = F.pow(F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n")), F.lit(p))
    factor = F.lit(1.0)
    for level, f in (boost or {}).items():
        factor = F.when(F.col(label) == F.lit(level), F.lit(float(f))).otherwise(factor)
    return counts.select(label, "n", (weight * factor).alias("weight"))


def pos_weight(df: DataFrame, label: str, p: float = 1.0) -> DataFrame:
    """Negatives per positive, raised to ``p`` (0.5 gives the damped weight)."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return counts.withColumn("weight", F.pow(F.col("neg") / F.when(F.col("pos") > 0, F.col("pos")), F.lit(p)))


def majority_version(df: DataFrame, code: str, version: str) -> DataFrame:
    """Most frequent version per code; none recorded -> 10 when the code starts with a letter, else 9."""
    known = mode_by(df.filter(F.coalesce(F.col(version), F.lit("")) != ""), [code], version, "version")
    guess = F.when(F.col(code).rlike("^[A-Za-z]"), F.lit("10")).otherwise(F.lit("9"))
    return df.select(code).distinct().join(known, code, "left") \
        .withColumn("version", F.coalesce(F.col("version"), guess))
