"""Exact-code retrieval inside a category: candidate index, blended scores, ranks, recall reports.

The index is a set of long tables keyed by (category, code). Its size is bounded by the code system,
not by the number of visits; it is stored, and joins carry no broadcast hint, so the planner broadcasts
it by its stored size and otherwise shuffles with adaptive skew splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import code_similarity
from ..functions.parsing import minmax
from ..session import durable
from .aggregates import mode_by
from .vectors import l2_rows


# --- index -------------------------------------------------------------------------------------------

def prevalence(df: DataFrame, cat: str, code: str) -> DataFrame:
    """``(category, code, n, prevalence)`` with the share inside the category."""
    counts = df.groupBy(cat, code).agg(F.count("*").alias("n"))
    totals = counts.groupBy(cat).agg(F.sum("n").alias("__total"))
    return counts.join(totals, cat).withColumn("prevalence", F.col("n") / F.col("__total")).drop("__total")


def text_centroids(vectors: DataFrame, rows: DataFrame, key: str, cat: str, code: str) -> DataFrame:
    """Mean of the L2 vectors per (category, code), scaled to length 1. The mean's divisor cancels in
    the scaling, so weights are only summed."""
    summed = vectors.join(rows.select(key, cat, code), key).groupBy(cat, code, "term").agg(F.sum("w").alias("w"))
    return l2_rows(summed, [cat, code])


def numeric_centroids(df: DataFrame, cat: str, code: str, cols: Sequence[str], prefix: str = "c_") -> DataFrame:
    return df.groupBy(cat, code).agg(*[F.avg(c).alias(prefix + c) for c in cols])


def attach_centroids(index: DataFrame, df: DataFrame, cat: str, code: str, cols: Sequence[str], mask: Column,
                     prefix: str = "m_") -> DataFrame:
    """Centroids over the masked rows only; a code without such rows gets the zero vector."""
    part = numeric_centroids(df.filter(mask), cat, code, cols, prefix)
    return index.join(part, [cat, code], "left").fillna(0.0, subset=[prefix + c for c in cols])


def build_index(rows: DataFrame, vectors: DataFrame, key: str, cat: str, code: str, title: str,
                physio: Sequence[str] = (), history: Sequence[str] = (),
                has_history: Column | None = None,
                store: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> dict[str, DataFrame]:
    """``candidates`` (prevalence with its min-max position, usual title, numeric centroids) and
    ``centroids`` (text). Run once per granularity with the matching code column.

    Both tables are written once: every question batch reads them, and their stored size lets the
    planner broadcast them when small instead of shuffling questions by their few categories. ``store``
    (name, builder) may keep them for later runs and call a builder only when it has no valid copy."""
    def candidates() -> DataFrame:
        cand = prevalence(rows, cat, code).join(mode_by(rows, [cat, code], title, "title"), [cat, code], "left")
        within = Window.partitionBy(cat)
        cand = cand.withColumn("prev_pos", stable(minmax(
            F.col("prevalence"), F.min("prevalence").over(within), F.max("prevalence").over(within))))
        if physio:
            cand = cand.join(numeric_centroids(rows, cat, code, physio), [cat, code])
        if history:
            cand = attach_centroids(cand, rows, cat, code, history,
                                    has_history if has_history is not None else F.lit(True))
        return cand

    keep = store if store is not None else lambda name, build: durable(build())
    return {"candidates": keep("candidates", candidates),
            "centroids": keep("centroids", lambda: text_centroids(vectors, rows, key, cat, code))}


def stable(col: Column, places: int = 9) -> Column:
    """Value at fixed places: sums reach a task in any order, and ranks must not depend on that. Terms
    are kept at nine places and their blends at twelve, so a blend is never cut in the middle."""
    return F.round(col, places)


# --- scoring -----------------------------------------------------------------------------------------

def candidates_for(queries: DataFrame, candidates: DataFrame, cat: str) -> DataFrame:
    """Each query with every code of its category; the per-category code list is a dimension."""
    return queries.join(candidates, cat, "inner")


def sparse_cosine(query_vectors: DataFrame, queries: DataFrame, centroids: DataFrame, key: str, cat: str,
                  code: str) -> DataFrame:
    """Non-zero cosines ``(key, category, code, cos)``: products of shared terms, summed."""
    return (queries.select(key, cat).join(query_vectors, key)
            .join(centroids.withColumnRenamed("w", "__c"), [cat, "term"])
            .groupBy(key, cat, code).agg(stable(F.sum(F.col("w") * F.col("__c"))).alias("cos")))


def _distance(cols: Sequence[str], prefix: str) -> Column:
    total = F.lit(0.0)
    for c in cols:
        gap = F.col(c) - F.col(prefix + c)
        total = total + gap * gap
    return stable(-F.sqrt(total))


def score_terms(queries: DataFrame, query_vectors: DataFrame, index: Mapping[str, DataFrame], key: str, cat: str,
                code: str, physio: Sequence[str] = (), history: Sequence[str] = ()) -> DataFrame:
    """Raw terms per (query, category, code) with their min-max positions inside the candidate set:
    ``text_pos``, ``vit_pos``, ``hist_pos``, ``prev_pos`` (flat terms 0.5)."""
    base = candidates_for(queries, index["candidates"], cat)
    cos = sparse_cosine(query_vectors, queries, index["centroids"], key, cat, code)
    out = base.join(cos, [key, cat, code], "left").withColumn("cos", F.coalesce("cos", F.lit(0.0)))
    out = out.withColumns({"vit": _distance(physio, "c_"), "hist": _distance(history, "m_")})
    return minmax_within(out, [key, cat], {"cos": "text_pos", "vit": "vit_pos", "hist": "hist_pos"})


def minmax_within(df: DataFrame, part: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    """Min-max position of each column inside its candidate set (bounded by the codes of a category)."""
    w = Window.partitionBy(*part)
    return df.withColumns({
        out: stable(minmax(F.col(c), F.min(c).over(w), F.max(c).over(w))) for c, out in cols.items()})


def blend2(alpha: float) -> Column:
    return stable(F.lit(alpha) * F.col("text_pos") + F.lit(1.0 - alpha) * F.col("prev_pos"), 12)


def blend3(weights: Mapping[str, float]) -> Column:
    """Text, vitals and prevalence; a zero vitals weight leaves that term out."""
    return stable(F.lit(float(weights["text"])) * F.col("text_pos") + F.lit(float(weights.get("vit", 0.0))) * F.col("vit_pos")
                  + F.lit(float(weights["prev"])) * F.col("prev_pos"), 12)


def gated_blend(with_history: Mapping[str, float], without: Mapping[str, float], has: Column) -> Column:
    """Four terms for queries with history, three terms with their own weights for the others."""
    four = stable(blend3(with_history) + F.lit(float(with_history.get("hist", 0.0))) * F.col("hist_pos"), 12)
    return F.when(has, four).otherwise(blend3(without))


def choose_path(has_vitals: Column, has_history_index: Column) -> Column:
    """Scoring path by available data: ``gated``, ``vitals`` or ``text``."""
    return F.when(has_vitals & has_history_index, "gated").when(has_vitals, "vitals").otherwise("text")


# --- ranks -------------------------------------------------------------------------------------------

def rank_within(df: DataFrame, part: Sequence[str], score: str, tie: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based rank, best score first, ties by ``tie`` ascending."""
    w = Window.partitionBy(*part).orderBy(F.desc(score), *[F.asc(t) for t in tie])
    return df.withColumn(name, F.row_number().over(w))


def top_k_within(df: DataFrame, part: Sequence[str], score: str, tie: Sequence[str], k: int,
                 name: str = "rank") -> DataFrame:
    """Best ``k`` per partition; the limit also applies before the shuffle (WindowGroupLimit)."""
    return rank_within(df, part, score, tie, name).filter(F.col(name) <= k)


def top_k_pruned(queries: DataFrame, query_vectors: DataFrame, index: Mapping[str, DataFrame], key: str, cat: str,
                 code: str, alpha: float, k: int) -> DataFrame:
    """The ``k`` best codes of each question by ``blend2`` without a row for every code of its category.

    Codes without a shared term all have the same text position, so at most the first ``k`` of them in order of
    prevalence can be in the list. A question thus meets the codes that share a term with it and as many places of its
    category's prevalence order as these may hide, plus ``k``. The extremes of the text term follow from the shared codes
    and the category's size. Rows and ranks equal those over all codes, as long as both weights are zero or 0.01 at least,
    so that unequal prevalence positions do not round to one score. ``n_met`` is the number of codes that were scored."""
    order = [F.asc(code)] if alpha >= 1.0 else [F.desc("prev_pos"), F.asc(code)]
    places = durable(index["candidates"].select(
        cat, code, "prev_pos", F.row_number().over(Window.partitionBy(cat).orderBy(*order)).alias("place"),
        F.count("*").over(Window.partitionBy(cat)).alias("n_codes")))
    shared = sparse_cosine(query_vectors, queries, index["centroids"], key, cat, code).join(
        places.select(cat, code, "prev_pos"), [cat, code])
    sizes = places.where("place = 1").select(cat, "n_codes")
    met = F.least(F.coalesce("n_shared", F.lit(0)) + k, F.col("n_codes"))
    asked = queries.select(key, cat).join(sizes, cat).join(
        shared.groupBy(key, cat).agg(F.count("*").alias("n_shared")), [key, cat], "left")
    ahead = asked.select(key, cat, F.explode(F.sequence(F.lit(1), met.cast("int"))).alias("place"), "n_codes").join(
        places.drop("n_codes"), [cat, "place"])
    both = shared.select(key, cat, code, "prev_pos", "cos", F.lit(None).cast("bigint").alias("n_codes")).unionByName(
        ahead.select(key, cat, code, "prev_pos", F.lit(None).cast("double").alias("cos"), "n_codes"))
    each = both.groupBy(key, cat, code).agg(*[F.max(c).alias(c) for c in ("prev_pos", "cos", "n_codes")])
    within = Window.partitionBy(key, cat)
    least = F.when(F.count("cos").over(within) < F.max("n_codes").over(within), 0.0).otherwise(F.min("cos").over(within))
    cos = F.coalesce("cos", F.lit(0.0))
    scored = each.withColumns({"text_pos": stable(minmax(cos, least, F.max(cos).over(within))), "n_met": F.count("*").over(within)}) \
        .withColumns({"cos": cos, "score": blend2(alpha)})
    return top_k_within(scored.drop("n_codes"), [key, cat], "score", [code], k)


def flat_top_k(per_cat: DataFrame, key: str, p_cat: str, score: str, tie: Sequence[str], k: int) -> DataFrame:
    """Across categories by ``p_category * score``."""
    combined = per_cat.withColumn("combined", stable(F.col(p_cat) * F.col(score), 12))
    return top_k_within(combined, [key], "combined", tie, k, "flat_rank")


def resolve(scored: DataFrame, cat_probs: DataFrame, key: str, cat: str, code: str, p_cat: str,
            score: str = "score", k_per_cat: int = 5, k_flat: int = 10) -> dict[str, DataFrame]:
    """Per-category lists and the flat list for queries with several likely categories."""
    per_cat = top_k_within(scored, [key, cat], score, [code], k_per_cat).join(cat_probs, [key, cat])
    return {"per_category": per_cat, "flat": flat_top_k(per_cat, key, p_cat, score, [cat, code], k_flat)}


def union_codes(per_cat: DataFrame, key: str, code: str) -> DataFrame:
    return per_cat.select(key, code).distinct()


def best_per_code(flat: DataFrame, key: str, code: str, score: str = "combined") -> DataFrame:
    """Each code once with its best score, ranked per query."""
    best = flat.groupBy(key, code).agg(F.max(score).alias(score))
    return rank_within(best, [key], score, [code], "flat_rank")


def top_missed(df: DataFrame, cat: str, name: str, n: int = 15) -> DataFrame:
    """Most frequent names per category, counted before they are ranked."""
    counts = df.groupBy(cat, name).agg(F.count("*").alias("n"))
    return top_k_within(counts, [cat], "n", [name], n)


def distinct_names(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str, n: int = 15,
                   out: str = "names") -> DataFrame:
    """First ``n`` names per key in first-seen order, compared without case, comma-joined."""
    clean = df.filter(F.trim(F.coalesce(F.col(name), F.lit(""))) != "").withColumn("__name", F.trim(name))
    first = clean.groupBy(*key, F.lower("__name").alias("__k")).agg(
        F.min(F.struct(*[F.col(o) for o in order], F.col("__name"))).alias("__f"))
    w = Window.partitionBy(*key).orderBy("__f")
    kept = first.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    return kept.groupBy(*key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("__rn", F.col("__f.__name").alias("v")))), lambda x: x["v"]), ", ").alias(out))


def take_first(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


# --- weight tuning -----------------------------------------------------------------------------------

def simplex(terms: Sequence[str], step: int = 10) -> list[dict[str, float]]:
    """All weights on the simplex in ``1/step`` steps, in counting order; the last term takes the rest."""
    points: list[list[int]] = [[]]
    for _ in terms[:-1]:
        points = [p + [i] for p in points for i in range(step + 1 - sum(p))]
    return [{t: round(v / step, 3) for t, v in zip(terms, [*p, step - sum(p)])} for p in points]


_POSITION = {"text": "text_pos", "vit": "vit_pos", "hist": "hist_pos", "prev": "prev_pos"}


#: Candidates whose scores are held at once for all points of a grid.
_SCORED = 1 << 12


def _hits(weights: np.ndarray, names: Sequence[str], k: int):
    """Per batch of questions and point, how many questions have fewer than ``k`` better candidates. ``gaps`` lists for each
    candidate by how much its terms exceed the true code's, and whether it goes first on a tie. An unknown term is never
    better."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = batch.column(0)
            sizes = pc.fill_null(pc.list_value_length(gaps), 0).to_numpy()
            question = np.repeat(np.arange(len(sizes)), sizes)
            flat = gaps.flatten()
            column = dict(zip((f.name for f in flat.type), flat.flatten()))
            known = np.ones(len(flat), bool)
            for t in [*names, "first"]:
                known &= column[t].is_valid().to_numpy(zero_copy_only=False)
            gap = np.stack([pc.fill_null(column[t], 0).to_numpy() for t in names], axis=1)
            first = pc.fill_null(column["first"], 0).to_numpy()
            better = np.zeros((len(sizes), len(weights)), np.int32)
            for lo in range(0, len(flat), _SCORED):
                part = slice(lo, lo + _SCORED)
                lead = (gap[part] @ weights.T * 2 + first[part, None] > 0) & known[part, None]
                asked = question[part]
                starts = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]]))
                better[asked[starts]] += np.add.reduceat(lead, starts, axis=0, dtype=np.int32)
            yield pa.record_batch([pa.array(np.arange(len(weights), dtype=np.int32)),
                                   pa.array((better < k).sum(axis=0, dtype=np.int64))], names=["point", "hits"])
    return run


def tune(terms: DataFrame, truth: DataFrame, grid: Sequence[Mapping[str, float]], key: str, code: str,
         k: int = 5, rows: DataFrame | None = None) -> DataFrame:
    """Top-``k`` hit rate per weight vector: ``(point, <weights>, hits, n, rate)``.

    A code's rank is one plus the number of better candidates. The candidates of a question (the codes of its category,
    as in ``minmax_within``) meet once, and all points are counted on them; only hits per point are shuffled then. A
    question whose true code is no candidate counts as a miss. A task sends one row per point and batch."""
    names = list(grid[0])
    want = truth.select(key, F.col(code).alias("__true"))
    n_rows = (rows if rows is not None else truth).select(key).distinct().agg(F.count("*")).scalar()
    # positions have nine places and weights six, so whole numbers compare as the rounded scores do
    whole = lambda c, places: F.round(c * 10.0 ** places).cast("bigint")
    entry = F.struct(F.col(code).alias("code"), *[whole(F.col(_POSITION[t]), 9).alias(t) for t in names])
    asked = terms.join(want, key).groupBy(key).agg(
        F.collect_list(entry).alias("cands"), F.max(F.when(F.col(code) == F.col("__true"), entry)).alias("own")) \
        .filter(F.col("own").isNotNull()).withColumn("gaps", F.transform("cands", lambda c: F.struct(
            *[(c[t] - F.col(f"own.{t}")).alias(t) for t in names], (c["code"] < F.col("own.code")).cast("bigint").alias("first"))))
    weights = np.asarray([[round(float(w[t]) * 10 ** 6) for t in names] for w in grid], np.int64).reshape(-1, len(names))
    hits = asked.select("gaps").mapInArrow(_hits(weights, names, k), "point int, hits long").groupBy("point").agg(F.sum("hits").alias("hits"))
    listing = terms.sparkSession.createDataFrame(
        [(i, *[float(w[t]) for t in names]) for i, w in enumerate(grid)],
        "point int, " + ", ".join(f"{t} double" for t in names))
    return (listing.join(hits, "point", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
            .withColumn("n", n_rows).withColumn("rate", F.col("hits") / F.col("n")))


def best_point(grid: DataFrame, metric: str, order: str = "point") -> DataFrame:
    """Row with the largest metric; the first one on ties."""
    return grid.orderBy(F.desc(metric), F.asc(order)).limit(1)


# --- reports -----------------------------------------------------------------------------------------

def true_ranks(ranked: DataFrame, truth: DataFrame, key: str, code: str, rank: str = "rank") -> DataFrame:
    """``(key, rank)`` of the true code among the ranked ones, NULL when it is not there."""
    hit = ranked.join(truth.select(key, code), [key, code]).groupBy(key).agg(F.min(rank).alias("rank"))
    return truth.select(key).join(hit, key, "left")


def oracle_recall(ranked: DataFrame, truth: DataFrame, key: str, code: str, ks: Sequence[int] = (1, 3, 5, 10),
                  by: Sequence[str] = ()) -> DataFrame:
    """Recall@k and mean reciprocal rank of the true code inside its true category."""
    ranks = true_ranks(ranked, truth, key, code)
    if by:
        ranks = ranks.join(truth.select(key, *by), key)
    return ranks.groupBy(*by).agg(
        F.count("*").alias("scored"),
        *[F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"recall_{k}") for k in ks],
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def end_to_end_recall(per_cat: DataFrame, truth: DataFrame, key: str, cat: str, code: str, p_cat: str,
                      score: str = "score", k_flat: int = 10) -> DataFrame:
    """Union, flat@k, flat MRR, conditional union recall and category recall in one row. ``truth``
    has the true category and code per query."""
    flat = best_per_code(per_cat.withColumn("combined", stable(F.col(p_cat) * F.col(score), 12)), key, code)
    flat_hit = flat.join(truth.select(key, code), [key, code]).select(key, "flat_rank")
    in_cat = per_cat.join(truth.select(key, cat), [key, cat]).select(key).distinct().withColumn("cat_ok", F.lit(1))
    rows = truth.select(key).join(flat_hit, key, "left").join(in_cat, key, "left")
    hit = F.col("flat_rank").isNotNull().cast("int")
    ok = F.coalesce("cat_ok", F.lit(0))
    return rows.agg(
        F.count("*").alias("n"), F.avg(hit).alias("union_recall"),
        F.avg((F.coalesce("flat_rank", F.lit(k_flat + 1)) <= k_flat).cast("int")).alias(f"flat_recall_{k_flat}"),
        F.avg(F.coalesce(1.0 / F.col("flat_rank"), F.lit(0.0))).alias("flat_mrr"),
        F.coalesce(F.avg(F.when(ok == 1, hit)), F.lit(0.0)).alias("conditional_recall"),
        F.avg(ok).alias("category_recall"))


def graded_at_k(ranked: DataFrame, sim: str, key: str, ks: Sequence[int] = (5, 10), rank: str = "rank") -> DataFrame:
    """Best similarity to the true code among the first k, averaged over queries."""
    best = ranked.groupBy(key).agg(*[
        F.coalesce(F.max(F.when(F.col(rank) <= k, F.col(sim))), F.lit(0.0)).alias(f"g{k}") for k in ks])
    return best.agg(F.count("*").alias("n"), *[F.avg(f"g{k}").alias(f"graded_{k}") for k in ks])


def tree_similarity(ranked: DataFrame, code: str, version: str, true_code: str, true_version: str,
                    name: str = "sim") -> DataFrame:
    return ranked.withColumn(name, code_similarity(
        F.col(true_code), F.col(true_version), F.col(code), F.col(version)))


def by_subset(df: DataFrame, subsets: Mapping[str, Column]) -> DataFrame:
    """One copy of a row per subset it belongs to, tagged ``subset``, for overlapping reports."""
    tags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]), lambda x: x.isNotNull())
    return df.withColumn("subset", F.explode(tags))


def before_after(a: DataFrame, b: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """Base and enriched report side by side with the difference."""
    left = a.select(*key, F.col(value).alias("before"))
    right = b.select(*key, F.col(value).alias("after"))
    return left.join(right, list(key), "full_outer").withColumn("delta", F.col("after") - F.col("before"))


def violations(report: DataFrame, pairs: Sequence[tuple[str, str]], tol: float = 1e-9) -> DataFrame:
    """Number of cells where a graded value falls below its strict one (always 0 for sound ranks)."""
    total = F.lit(0).cast("bigint")
    for strict, graded in pairs:
        total = total + F.count_if(F.col(graded) + tol < F.col(strict))
    return report.agg(total.alias("violations"))


def summary_long(report: DataFrame, section: str, model: str, granularity: str, variant: str) -> DataFrame:
    """A one-row report as ``(section, model, granularity, variant, metric, value)``."""
    cols = [F.col(c).cast("double").alias(c) for c in report.columns]
    return report.unpivot([], cols, "metric", "value").select(
        F.lit(section).alias("section"), F.lit(model).alias("model"), F.lit(granularity).alias("granularity"),
        F.lit(variant).alias("variant"), "metric", "value")
