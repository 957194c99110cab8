"""Features of timed readings: bounded windows, series statistics, abnormal counts, modal buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import ABNORMAL, CLIP_RANGES, VITALS
from ..functions.text import RHYTHM_BUCKETS, bucket_rhythm
from ..session import durable
from .clean import clip_range, coerce_numeric
from .joins import within_window
from .prefix import number_rows, time_buckets


def series_stats(df: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Min, max, last and delta (last - first) per column; NULL readings are skipped per column.
    ``order`` is the reading order, for instance time then reading id."""
    aggs = []
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.struct(*[F.col(o) for o in order], F.col(c).alias("__v")))
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
                 F.max(at).getField("__v").alias(f"{c}_last"),
                 (F.max(at).getField("__v") - F.min(at).getField("__v")).alias(f"{c}_delta")]
    return df.groupBy(*key).agg(*aggs)


def count_where(df: DataFrame, key: Sequence[str], spec: Mapping[str, Column]) -> DataFrame:
    """Conditional row counts per key."""
    return df.groupBy(*key).agg(*[F.count_if(c).alias(n) for n, c in spec.items()])


def any_where(df: DataFrame, key: Sequence[str], pred: Column, name: str) -> DataFrame:
    """1 when any row of the key satisfies the predicate."""
    return df.groupBy(*key).agg(F.coalesce(F.bool_or(pred), F.lit(False)).cast("int").alias(name))


def modal_bucket(df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: str, name: str = "modal") -> DataFrame:
    """Most frequent bucket per key; on ties the one seen first. Counted per bucket first, so the
    second step sees at most one row per bucket."""
    seen = F.struct(*[F.col(o) for o in order])
    per = df.filter(F.coalesce(F.col(bucket), F.lit("")) != "").groupBy(*key, bucket) \
        .agg(F.count("*").alias("__n"), F.min(seen).alias("__first"))
    best = F.min(F.struct((-F.col("__n")).alias("neg"), F.col("__first"), F.col(bucket).alias("value")))
    return per.groupBy(*key).agg(best.getField("value").alias(name))


def reading_sequence(df: DataFrame, key: Sequence[str], ts: str, tie: str, col: str,
                     bucket_seconds: int = 300) -> DataFrame:
    """Chronological readings in long form: key, ``reading_no``, time, value. A key of any size
    stays spread over its time buckets."""
    rows = df.filter(F.col(col).isNotNull()).select(*key, ts, tie, col)
    return number_rows(rows, list(key), [ts, tie], time_buckets(ts, bucket_seconds), "reading_no")


def reading_arrays(sequence: DataFrame, key: Sequence[str], col: str, size: int = 1000) -> DataFrame:
    """Readings as arrays of at most ``size`` values per row: key, ``part_no``, values. All readings
    are kept; a key with more gets further parts."""
    part = F.floor((F.col("reading_no") - 1) / F.lit(size)).cast("bigint")
    packed = sequence.withColumn("part_no", part).groupBy(*key, "part_no").agg(
        F.array_sort(F.collect_list(F.struct("reading_no", F.col(col).alias("v")))).alias("__r"))
    return packed.select(*key, "part_no", F.transform("__r", lambda r: r["v"]).alias(col))


def longitudinal_features(readings: DataFrame, stays: DataFrame, key: str = "stay_id", ts: str = "charttime",
                          anchor_ts: str = "intime", hours: float = 4.0, rhythm: str = "rhythm",
                          vitals: Sequence[str] = VITALS, abnormal: Mapping[str, tuple[str, str, float]] = ABNORMAL,
                          tie: str | None = None) -> DataFrame:
    """Complete window block per stay that has readings: vital statistics, abnormal counts, rhythm
    one-hot, irregular flag. ``readings`` holds the raw rows, ``stays`` one row per stay.

    The rows inside the windows are stored: all readings are read and shuffled once, not once per block, and the filter of
    the modal bucket is not moved to the scan, where it would put every reading of the table into a bucket."""
    order = [ts] if tie is None else [ts, tie]
    inside = durable(within_window(readings, stays.select(key, anchor_ts), key, ts, anchor_ts, hours))
    clean = clip_range(coerce_numeric(inside, vitals), {v: CLIP_RANGES[v] for v in vitals if v in CLIP_RANGES}) \
        .withColumn("__bucket", bucket_rhythm(F.col(rhythm)))
    stats = series_stats(clean, [key], order, vitals)
    over = lambda c, op, lim: F.col(c) > lim if op == ">" else F.col(c) < lim
    counts = clean.groupBy(key).agg(
        *[F.count_if(over(*rule)).alias(f"n_{name}_readings") for name, rule in abnormal.items()],
        F.coalesce(F.bool_or((F.col("__bucket") != "") & (F.col("__bucket") != "sinus")), F.lit(False))
        .cast("int").alias("rhythm_irregular"))
    modal = modal_bucket(clean, [key], order, "__bucket", "__modal")
    out = stats.join(counts, key).join(modal, key, "left")
    return out.withColumns({
        **{f"rhythm_{b}": F.coalesce((F.col("__modal") == b).cast("int"), F.lit(0)) for b in RHYTHM_BUCKETS},
        "has_longitudinal_vitals": F.lit(1)}).drop("__modal")
