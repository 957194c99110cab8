"""Row filters, cleaning rules and derived columns of a visit cohort.

All functions are narrow projections or filters: they add no shuffle and stay inside generated code."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import durable
from .prefix import exact_quantiles, number_rows


# --- filters -----------------------------------------------------------------------------------

def require_text(df: DataFrame, col: str) -> DataFrame:
    """Rows whose text is neither NULL nor blank."""
    return df.filter(F.col(col).isNotNull() & (F.trim(col) != ""))


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def primary_only(df: DataFrame, seq: str = "seq_num") -> DataFrame:
    """First-listed record of each parent."""
    return df.filter(F.col(seq) == 1)


def valid_int(df: DataFrame, col: str, lo: int, hi: int) -> DataFrame:
    """Keep rows whose value parses and lies in [lo, hi]; the column becomes an int."""
    num = F.col(col).cast("string").try_cast("double")
    return df.withColumn(col, num).filter(F.col(col).between(lo, hi)).withColumn(col, F.col(col).cast("int"))


def exclude_with_audit(df: DataFrame, col: str, value) -> tuple[DataFrame, Observation]:
    """Drop a catch-all level. The observation reports rows before and after; it fills while the
    first action on the result runs, so counting costs no extra job."""
    seen = Observation("exclude_with_audit")
    counted = df.observe(seen, F.count(F.lit(1)).alias("before"),
                         F.count_if(~F.col(col).eqNullSafe(F.lit(value))).alias("after"))
    return counted.filter(~F.col(col).eqNullSafe(F.lit(value))), seen


# --- labels and levels ---------------------------------------------------------------------------

def binary_label(df: DataFrame, col: str, positive, name: str = "label") -> DataFrame:
    """1 where the level is the positive one, else 0 (NULL counts as 0)."""
    return df.withColumn(name, F.coalesce((F.col(col) == F.lit(positive)).cast("int"), F.lit(0)))


def map_with_default(df: DataFrame, col: str, mapping: Mapping[str, str], default: str, name: str) -> DataFrame:
    """Level grouping by a small fixed map; levels outside it become ``default``."""
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return df.withColumn(name, F.coalesce(F.try_element_at(lookup, F.col(col)), F.lit(default)))


def one_hot_fixed(df: DataFrame, col: str, levels: Mapping[str, str]) -> DataFrame:
    """0/1 column per wanted level (``output name -> level``); NULL gives 0 everywhere."""
    return df.withColumns({
        name: F.coalesce((F.col(col) == F.lit(level)).cast("int"), F.lit(0)) for name, level in levels.items()})


def normalize_field(col: Column, mapping: Mapping[str, str], default: str,
                    unknown: Sequence[str] = ("", "NAN", "UNKNOWN"), unknown_as: str = "unknown") -> Column:
    """Raw level -> input vocabulary: trimmed, upper-cased, mapped; blanks and unknowns share one level."""
    key = F.upper(F.trim(F.coalesce(col, F.lit(""))))
    out = F.when(key.isin(*unknown), F.lit(unknown_as))
    for raw, value in mapping.items():
        out = out.when(key == raw.upper(), F.lit(value))
    return out.otherwise(F.lit(default))


def label_index(df: DataFrame, col: str, name: str = "label_idx") -> DataFrame:
    """Sorted distinct labels -> 0..K-1. Only the distinct labels are ranked, never the rows, and none is gathered: they
    are stored in ranges, whose numbers are the buckets of the order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = df.select(col).filter(F.col(col).isNotNull()).distinct()
    ranges = durable(labels.repartitionByRange(n, col).withColumn("__range", F.spark_partition_id()))
    ranked = number_rows(ranges, [], [col], [F.col("__range")], "__no")
    return df.join(ranked.select(col, (F.col("__no") - 1).cast("int").alias(name)), col, "inner")


# --- numbers -------------------------------------------------------------------------------------

def clean_bounded_score(df: DataFrame, col: str, lo: int = 0, hi: int = 10, missing: int = -1) -> DataFrame:
    """Score as int: unparsable or missing sets ``<col>_missing``; cut towards zero; outside -> ``missing``."""
    num = F.col(col).cast("string").try_cast("double")
    cut = F.coalesce(num, F.lit(float(missing))).cast("int")
    return df.withColumns({
        f"{col}_missing": num.isNull().cast("int"),
        col: F.when(cut.between(lo, hi), cut).otherwise(F.lit(missing)),
    })


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Double or NULL, with ``<col>_missing`` flags; NaN counts as missing."""
    def num(c: str) -> Column:
        v = F.col(c).cast("string").try_cast("double")
        return F.when(~F.isnan(v), v)
    return df.withColumns({**{f"{c}_missing": num(c).isNull().cast("int") for c in cols},
                           **{c: num(c) for c in cols}})


def clip_range(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Pull values to the nearest bound; NULL stays NULL (``greatest`` alone would drop it)."""
    return df.withColumns({
        c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(float(lo))), F.lit(float(hi))))
        for c, (lo, hi) in bounds.items()})


def null_out_of_range(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values outside the bounds become NULL."""
    return df.withColumns({c: F.when(F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in bounds.items()})


def fill_constants(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.fillna({k: float(v) for k, v in values.items()})


def fit_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact medians as rows ``(column, median)``."""
    return exact_quantiles(df, cols, {"median": 0.5})


def apply_median(df: DataFrame, medians: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill NULLs from a fitted median table (one row per column), read once as a scalar subquery."""
    table = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", "median")))).scalar()
    filled = {c: F.coalesce(F.col(c).cast("double"), F.try_element_at("__fit", F.lit(c))) for c in cols}
    return df.withColumn("__fit", table).withColumns(filled).drop("__fit")


def threshold_flags(df: DataFrame, spec: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """0/1 flags ``name: (column, '>' or '<', limit)``; NULL never flags."""
    def flag(col: str, op: str, limit: float) -> Column:
        hit = F.col(col) > limit if op == ">" else F.col(col) < limit
        return F.coalesce(hit.cast("int"), F.lit(0))
    return df.withColumns({name: flag(*rule) for name, rule in spec.items()})


def flag_count(df: DataFrame, flags: Sequence[str], name: str = "abnormal_vital_count") -> DataFrame:
    total = F.col(flags[0])
    for f in flags[1:]:
        total = total + F.col(f)
    return df.withColumn(name, total)


def mean_arterial(df: DataFrame, sbp: str, dbp: str, name: str = "map") -> DataFrame:
    return df.withColumn(name, (F.col(sbp) + 2 * F.col(dbp)) / 3)


def age_at(df: DataFrame, ts: str, anchor_age: str, anchor_year: str, name: str = "age",
           fallback: int = 50) -> DataFrame:
    """Age at a visit from an anchored age, limited to 0..120; unknown -> ``fallback``."""
    raw = F.col(anchor_age) + (F.year(ts) - F.col(anchor_year))
    limited = F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0)), F.lit(120)))
    return df.withColumn(name, F.coalesce(limited, F.lit(fallback)).cast("int"))


def mask_unless(df: DataFrame, cols: Sequence[str], pred: Column) -> DataFrame:
    """Measurements are kept only where the predicate holds."""
    return df.withColumns({c: F.when(pred, F.col(c)) for c in cols})


def mask_features(df: DataFrame, pred: Column, medians: Mapping[str, float], flags: Sequence[str],
                  counts: Sequence[str] = ()) -> DataFrame:
    """Hide measured features where ``pred`` is not true: median value, missing flag 1, flags and
    counts 0 — what a scorer sees for a visit without measurements."""
    keep = F.coalesce(pred, F.lit(False))
    cols = {c: F.when(keep, F.col(c)).otherwise(F.lit(float(m))) for c, m in medians.items()}
    cols.update({f"{c}_missing": F.when(keep, F.col(f"{c}_missing")).otherwise(F.lit(1)) for c in medians})
    cols.update({f: F.when(keep, F.col(f)).otherwise(F.lit(0)) for f in [*flags, *counts]})
    return df.withColumns(cols)


def right_closed_bins(df: DataFrame, col: str, edges: Sequence[float], default: int, name: str) -> DataFrame:
    """Bin i covers (edges[i], edges[i+1]]; anything else gets ``default``."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        cond = (F.col(col) > lo) & (F.col(col) <= hi)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return df.withColumn(name, out.otherwise(F.lit(default)))


def bands(df: DataFrame, col: str, spec: Mapping[str, tuple[float, float]]) -> DataFrame:
    """0/1 column per closed band."""
    return df.withColumns({
        name: F.coalesce(F.col(col).between(lo, hi).cast("int"), F.lit(0)) for name, (lo, hi) in spec.items()})


def interactions(df: DataFrame, spec: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Products of existing columns, ``name: (left, right)``."""
    return df.withColumns({name: F.col(a) * F.col(b) for name, (a, b) in spec.items()})


def severity_interactions(df: DataFrame, pain: str, age: str, severity: str) -> DataFrame:
    """Pain (limited to 0..10) and age, each times the distance of the severity from its mild end 5."""
    pain_0_10 = F.least(F.greatest(F.col(pain), F.lit(0)), F.lit(10))
    return df.withColumns({"pain_x_min_severity": pain_0_10 * (5 - F.col(severity)),
                           "age_severity": F.col(age) * (5 - F.col(severity))})


def count_parts(df: DataFrame, col: str, sep: str = ",", name: str = "n_complaints") -> DataFrame:
    """Number of non-blank parts between separators."""
    parts = F.split(F.coalesce(F.col(col), F.lit("")), re.escape(sep))
    return df.withColumn(name, F.size(F.filter(parts, lambda p: F.trim(p) != "")).cast("int"))


# --- defaults after left joins -------------------------------------------------------------------

NO_PRIOR_DAYS = 9999


def fill_history_defaults(df: DataFrame, flags: Sequence[str], counts: Sequence[str] = ("n_prior_admissions", "n_prior_ed_visits"),
                          days: Sequence[str] = ("days_since_last_admission", "days_since_last_ed"),
                          scores: Sequence[str] = ("same_complaint_as_prior",)) -> DataFrame:
    """History block of a visit without one: no_history 1, recency 9999 days, all else 0."""
    have = set(df.columns)
    val = lambda c, typ, d: F.coalesce(F.col(c).cast(typ), F.lit(d).cast(typ)) if c in have else F.lit(d).cast(typ)
    return df.withColumns({
        "no_history": val("no_history", "int", 1),
        **{c: val(c, "int", 0) for c in flags},
        **{c: val(c, "bigint", 0) for c in counts},
        **{c: val(c, "double", NO_PRIOR_DAYS) for c in days},
        **{c: val(c, "double", 0) for c in scores}})


def fill_med_defaults(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Medication block of a visit without a list: ``meds_unknown`` 1, count and flags 0."""
    return df.withColumns({
        "n_medications": F.coalesce(F.col("n_medications"), F.lit(0)).cast("bigint"),
        "meds_unknown": F.coalesce(F.col("meds_unknown"), F.lit(1)).cast("int"),
        **{c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in flags}})


def fill_longitudinal(df: DataFrame, vitals: Sequence[str], counts: Mapping[str, str],
                      buckets: Sequence[str] = (), has: str = "has_longitudinal_vitals") -> DataFrame:
    """Window features with the single snapshot behind them: without readings min = max = last =
    snapshot, delta 0, reading counts = snapshot flags (``counts: count column -> flag column``)."""
    present = F.coalesce(F.col(has), F.lit(0)) == 1
    cols = {}
    for v in vitals:
        for stat in ("min", "max", "last"):
            cols[f"{v}_{stat}"] = F.coalesce(F.when(present, F.col(f"{v}_{stat}")), F.col(v))
        cols[f"{v}_delta"] = F.coalesce(F.when(present, F.col(f"{v}_delta")), F.lit(0.0))
    for count, flag in counts.items():
        cols[count] = F.coalesce(F.when(present, F.col(count)).otherwise(F.col(flag)), F.lit(0)).cast("bigint")
    for b in buckets:
        cols[b] = F.coalesce(F.col(b), F.lit(0)).cast("int")
    cols[has] = present.cast("int")
    return df.withColumns(cols)


# --- assembly ------------------------------------------------------------------------------------

def slug(name: str) -> str:
    """Label text as a column name."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def assemble(df: DataFrame, blocks: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """Select named feature blocks in order; a column in two blocks is an error."""
    cols = list(keep) + [c for block in blocks.values() for c in block]
    twice = sorted({c for c in cols if cols.count(c) > 1})
    if twice:
        raise ValueError(f"columns in more than one block: {twice}")
    return df.select(*cols)


def choose_block(df: DataFrame, record: str, reported: Mapping[str, Column], any_reported: Column,
                 defaults: Mapping[str, object]) -> DataFrame:
    """Block precedence per row: the complete record struct, else what the text reports, else
    defaults; ``used_record`` says whether the record won."""
    has = F.col(record).isNotNull()
    cols = {}
    for name, fallback in defaults.items():
        own = F.when(any_reported, F.coalesce(reported[name], F.lit(fallback))).otherwise(F.lit(fallback)) \
            if name in reported else F.lit(fallback)
        cols[name] = F.when(has, F.col(f"{record}.{name}")).otherwise(own)
    cols["used_record"] = has.cast("int")
    return df.withColumns(cols)
