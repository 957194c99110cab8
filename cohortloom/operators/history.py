"""Leakage-safe history: everything about a subject strictly before a visit.

Visits and earlier encounters meet by subject in one shuffle; a frame that ends before the visit's own time gives the totals,
so nothing is joined back. Subjects with more than ``HOT`` rows are told apart first: their running totals come from
``prefix.with_prior``, which spreads them over their time buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import days_between, micros
from ..functions.text import jaccard, token_set
from .aggregates import union_sets
from .clean import NO_PRIOR_DAYS
from .prefix import time_buckets, with_prior

_BUCKET = 300
#: Rows of one subject that one task orders as a whole; results do not depend on it.
HOT = 1 << 17
#: Buckets that rows are counted by before subjects are.
_CROWDS = 1 << 16


def prior_measures(anchors: DataFrame, events: DataFrame | None, subject: str, ts: str,
                   measures: Mapping[str, tuple[str, Column]], bucket_seconds: int = _BUCKET,
                   own: Mapping[str, Column] | None = None) -> DataFrame:
    """``anchors`` plus, per measure ``name: (sum|max, column of events)``, its total over the events
    of the same subject with a strictly earlier time; NULL when there is none. Both inputs carry
    ``subject`` and ``ts``.

    ``own`` gives the measures of the anchors themselves, where these are events too; ``events`` then holds the others. With
    the same frame on both sides this is done at once. Rows are counted per bucket of subjects, and per subject if need be,
    before the plan is made."""
    if own is None and events is anchors:
        own, events = {n: c for n, (_, c) in measures.items()}, None
    combine = {"sum": F.sum, "max": F.max}
    known = F.col(subject).isNotNull() & F.col(ts).isNotNull()
    held = {n: f"__m{i}" for i, n in enumerate(measures)}
    others = [c for c in anchors.columns if c not in (subject, ts)]
    # anchors without subject or time have no history; their hash keeps them out of one group
    hashed = [f.name for f in anchors.schema if "map<" not in f.dataType.simpleString()]
    marks = anchors.withColumns({"__own": F.lit(True), "__lone": F.when(~known, F.xxhash64(*hashed))})
    tagged = None if events is None else events.filter(known).select(
        subject, ts, *[c.alias(held[n]) for n, (_, c) in measures.items()], F.lit(False).alias("__own"))
    types = {n: None if tagged is None else tagged.schema[held[n]].dataType for n in measures}
    value = lambda n: F.when(known, own[n]) if own is not None else F.lit(None).cast(types[n])
    rows = marks.withColumns({held[n]: value(n) for n in measures})
    if tagged is not None:
        rows = rows.unionByName(tagged, allowMissingColumns=True)

    earlier = Window.partitionBy(subject, "__lone").orderBy(micros(ts)).rangeBetween(Window.unboundedPreceding, -1)
    placed = lambda df: df.select(subject, ts, "__own", *others, *[
        combine[kind](held[n]).over(earlier).alias(f"__prior_{n}") for n, (kind, _) in measures.items()]).filter("__own")
    final = [subject, ts, *others, *[F.col(f"__prior_{n}").alias(n) for n in measures]]
    crowded = lambda *by: rows.filter(known).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
    # a bucket has at least the rows of each of its subjects, so subjects are counted only where a bucket has that many
    hot = crowded(subject).select(subject)
    if crowded(F.pmod(F.xxhash64(subject), F.lit(_CROWDS)).alias("crowd")).isEmpty() or hot.isEmpty():
        return placed(rows).select(*final)
    cold, spread = rows.join(hot, subject, "left_anti"), rows.join(hot, subject, "left_semi")
    moments = spread.filter(known).groupBy(subject, ts).agg(*[combine[kind](held[n]).alias(held[n]) for n, (kind, _) in measures.items()])
    before = with_prior(moments, [subject], [ts], time_buckets(ts, bucket_seconds),
                        {f"__prior_{n}": (kind, held[n]) for n, (kind, _) in measures.items()})
    far = spread.filter("__own").join(before.select(subject, ts, *[f"__prior_{n}" for n in measures]), [subject, ts], "left")
    return placed(cold).select(*final).unionByName(far.select(*final))


def recency(ts: Column, last: Column) -> Column:
    """Days since ``last``, limited to 0..9999; 9999 when there is none."""
    days = days_between(last, ts)
    return F.when(last.isNull(), F.lit(float(NO_PRIOR_DAYS))).otherwise(
        F.least(F.greatest(days, F.lit(0.0)), F.lit(float(NO_PRIOR_DAYS))))


def history_features(stays: DataFrame, ed: DataFrame, adm: DataFrame, flags: Sequence[str],
                     subject: str = "subject_id", stay: str = "stay_id", ts: str = "intime",
                     text: str = "complaint_text_norm", bucket_seconds: int = _BUCKET) -> DataFrame:
    """One row per stay with the complete history block.

    ``ed``: every earlier-or-later visit (subject, stay, ts, text). ``adm``: every admission (subject,
    ts and 0/1 ``flags`` merged from codes and notes). Ties on time take the larger stay id."""
    visit = F.struct(F.col(ts).alias("at"), F.col(stay).cast("bigint").alias("id"), F.col(text).alias("text"))
    measures = lambda is_adm, is_ed, last_adm, last_visit, flag: {
        "n_prior_admissions": ("sum", F.lit(is_adm).cast("bigint")), "n_prior_ed_visits": ("sum", F.lit(is_ed).cast("bigint")),
        "__last_adm": ("max", last_adm), "__last_visit": ("max", last_visit), **{f: ("max", flag(f)) for f in flags}}
    of_visit = measures(0, 1, F.when(F.lit(False), F.col(ts)), visit, lambda f: F.lit(None).cast("int"))
    of_adm = measures(1, 0, F.col(ts), F.lit(None).cast(ed.select(visit.alias("v")).schema["v"].dataType), lambda f: F.col(f).cast("int"))
    named = lambda df, of: df.select(subject, ts, *[c.alias(n) for n, (_, c) in of.items()])
    events, own = named(adm, of_adm), {n: c for n, (_, c) in of_visit.items()}
    if ed is not stays:
        events, own = named(ed, of_visit).unionByName(events), None
    out = prior_measures(stays.select(subject, stay, ts, text), events, subject, ts,
                         {n: (kind, F.col(n)) for n, (kind, _) in of_adm.items()}, bucket_seconds, own)
    return history_block(out, ts, text, flags).select(
        stay, *flags, "n_prior_admissions", "n_prior_ed_visits", "days_since_last_admission",
        "days_since_last_ed", "same_complaint_as_prior", "no_history")


def history_block(df: DataFrame, ts: str, text: str, flags: Sequence[str]) -> DataFrame:
    """Named history columns from the raw prior totals."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    # columns of their own, so that each text is cut into words once
    df = df.withColumns({"__now": token_set(F.col(text)), "__then": token_set(F.col("__last_visit.text"))})
    now, then = F.col("__now"), F.col("__then")
    same = F.when((F.size(now) > 0) & (F.size(then) > 0), jaccard(now, then)).otherwise(F.lit(0.0))
    return df.withColumns({
        **{f: F.coalesce(F.col(f), F.lit(0)).cast("int") for f in flags},
        "n_prior_admissions": n("n_prior_admissions"),
        "n_prior_ed_visits": n("n_prior_ed_visits"),
        "days_since_last_admission": recency(F.col(ts), F.col("__last_adm")),
        "days_since_last_ed": recency(F.col(ts), F.col("__last_visit.at")),
        "same_complaint_as_prior": F.bround(same, 4),
        "no_history": ((n("n_prior_admissions") == 0) & (n("n_prior_ed_visits") == 0)).cast("int"),
    }).drop("__now", "__then")


def prior_encounters(anchors: DataFrame, history: DataFrame, subject: str, ts: str) -> DataFrame:
    """Strictly earlier encounters per anchor: their number and the latest time."""
    return prior_measures(anchors, history, subject, ts, {
        "n_prior": ("sum", F.lit(1).cast("bigint")), "last_prior": ("max", F.col(ts))})


def last_prior_value(anchors: DataFrame, history: DataFrame, subject: str, ts: str, order_id: str,
                     payload: Column, has_payload: Column, name: str = "last_prior") -> DataFrame:
    """Payload of the latest earlier encounter that has one; equal times take the larger id."""
    entry = F.when(has_payload, F.struct(F.col(ts).alias("at"), F.col(order_id).alias("id"), payload.alias("value")))
    out = prior_measures(anchors, history, subject, ts, {"__entry": ("max", entry)})
    return out.withColumn(name, F.col("__entry.value")).drop("__entry")


def anchor_now(ed: DataFrame, adm: DataFrame, subject: str, ts: str) -> DataFrame:
    """Latest encounter of either kind per subject, to be used as "now"."""
    return (ed.select(subject, ts).unionByName(adm.select(subject, ts))
            .groupBy(subject).agg(F.max(ts).alias(ts)))


def flags_by_admission(icd: DataFrame, code_groups: DataFrame, notes: DataFrame, flags: Mapping[str, str],
                       hadm: str = "hadm_id", drop_group: str | None = None) -> DataFrame:
    """0/1 flags per admission, from coded diagnoses (``icd_code`` -> ``group``) and from note flags.
    Codes outside the map and the catch-all group raise nothing."""
    wanted = code_groups if drop_group is None else code_groups.filter(F.col("group") != drop_group)
    hits = icd.join(wanted, "icd_code", "inner").groupBy(hadm, "group").agg(F.lit(1).alias("hit"))
    coded = hits.groupBy(hadm).agg(*[
        F.max(F.when(F.col("group") == cat, 1).otherwise(0)).alias(col) for cat, col in flags.items()])
    return union_sets(coded, notes.filter(F.col(hadm).isNotNull()), [hadm], list(flags.values()))


def build_history_index(ed: DataFrame, adm: DataFrame, icd_flags: DataFrame, note_flags: DataFrame,
                        meds: DataFrame, subjects: DataFrame | None = None, subject: str = "subject_id",
                        hadm: str = "hadm_id", stay: str = "stay_id") -> dict[str, DataFrame]:
    """Five keyed tables that answer any later lookup, for all subjects or a given list."""
    pick = (lambda df: df) if subjects is None else \
        (lambda df: df.join(subjects.select(subject), subject, "left_semi"))
    ed_part, adm_part = pick(ed), pick(adm)
    return {
        "ed_visits": ed_part, "admissions": adm_part,
        "icd_flags": icd_flags.join(adm_part.select(hadm), hadm, "left_semi"),
        "note_flags": note_flags.join(adm_part.select(hadm), hadm, "left_semi"),
        "med_blocks": meds.join(ed_part.select(stay), stay, "left_semi"),
    }


def save_history_index(index: Mapping[str, DataFrame], path: str,
                       order: Mapping[str, Sequence[str]]) -> None:
    """Each table is written range-partitioned and sorted by its own order, key first and time
    second, so that a lookup prunes files and a hot subject still spans several files."""
    for name, df in index.items():
        cols = list(order[name])
        df.repartitionByRange(*cols).sortWithinPartitions(*cols).write.mode("overwrite").parquet(f"{path}/{name}")


def load_history_index(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
