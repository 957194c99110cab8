"""Level-wise n-grams against counting every gram."""

import random
from collections import Counter

import pytest

from cohortloom.operators import grams as G
from cohortloom.operators import vectors as W


def plain(rows, lo, hi, min_df, max_df, max_terms):
    df, cf, found = Counter(), Counter(), Counter()
    for key, text in rows:
        t = (text or "").split()
        mine = [" ".join(t[i:i + n]) for n in range(lo, hi + 1) for i in range(len(t) - n + 1)]
        df.update(set(mine))
        cf.update(mine)
        found.update((key, g) for g in mine)
    kept = sorted((t for t in df if min_df <= df[t] <= max_df * len(rows)), key=lambda t: (-cf[t], t))[:max_terms]
    return ({(t, df[t], cf[t]) for t in kept}, {k: n for k, n in found.items() if k[1] in set(kept)})


@pytest.mark.parametrize("lo, hi, min_df, max_df, max_terms", [
    (1, 3, 3, 0.95, 40), (1, 3, 2, 0.3, None), (2, 4, 3, 1.0, 15), (1, 1, 1, 1.0, None), (3, 3, 2, 1.0, None)])
def test_same_grams_as_counting_all(spark, lo, hi, min_df, max_df, max_terms):
    draw = random.Random(lo * 10 + hi)
    words = [f"w{i}" for i in range(14)]
    rows = [(i % 70, " ".join(draw.choices(words, range(1, 15), k=draw.randrange(30)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "w1"), (203, "w13 " * 400), (204, "w13 w12"), (205, "only here")]
    rows += [(300, "w3 w4 w5 w3 w4 w5")] * 4
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    voc, found = G.fit_grams(df, "id", "t", len(rows), lo, hi, min_df, max_df, max_terms)
    want, occurrences = plain(rows, lo, hi, min_df, max_df, max_terms)
    assert {tuple(r) for r in voc.collect()} == want
    assert {(r.id, r.term): r["count"] for r in found.groupBy("id", "term").count().collect()} == occurrences


def test_weights_agree_with_whole_grams(spark):
    df = spark.createDataFrame([(1, "red blue red"), (2, "blue green"), (3, "red blue"), (4, None)], "id long, t string")
    voc, found = G.fit_grams(df, "id", "t", 4, 1, 2, 2, 1.0)
    model = W.fit_tfidf(voc, 4)
    got = {(r.id, r.term): r.w for r in W.weigh(found, model, "id").collect()}
    want = {(r.id, r.term): r.w for r in W.apply_tfidf(W.gram_arrays(df, "id", "t", 1, 2), model, "id").collect()}
    assert got == pytest.approx(want)


def test_no_rows(spark):
    voc, found = G.fit_grams(spark.createDataFrame([], "id long, t string"), "id", "t", 0)
    assert voc.count() == 0 and found.count() == 0


def test_totals_per_key_shuffle_no_grams(spark):
    rows = [(1, "a1 b1 a1 b1 a1"), (2, ""), (3, None), (4, "x1 y1"), (4, "y1 x1 y1"), (None, "q1 q1"), (None, "q1"), (5, "É1 e1 a" * 300)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    out = W.gram_totals(df, "id", "t")
    tf = W.term_counts(W.gram_arrays(df, "id", "t"), "id").collect()
    want = {k: (sum(r.id == k for r in tf), sum(r.tf for r in tf if r.id == k), max(r.tf for r in tf if r.id == k)) for k in (1, 4, 5, None)}
    assert {r.id: (r.n_terms, r.n_grams, r.top_tf) for r in out.collect()} == want
    single = W.gram_totals(df.where("id in (1, 5)"), "id", "t")
    single.collect()
    plan = single._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "hashpartitioning(id" not in final


def test_a_floor_leaves_few_occurrences(spark, monkeypatch):
    """Two terms wanted of one that is everywhere and forty others: only occurrences of the words at the floor are kept."""
    sizes, keep = [], G.durable
    monkeypatch.setattr(G, "durable", lambda df: sizes.append((set(df.columns), (out := keep(df)).count())) or out)
    rows = [(i, "top next " * 5 + " ".join(f"w{j}" for j in range(40))) for i in range(10)]
    voc, found = G.fit_grams(spark.createDataFrame(rows, "id long, t string"), "id", "t", 10, 1, 3, 2, 1.0, 2)
    assert [tuple(r) for r in voc.collect()] == [("next", 10, 50), ("top", 10, 50)]
    assert found.count() == 100
    assert max(n for cols, n in sizes if {"row", "pos"} <= cols) == 100  # 500 words in all
