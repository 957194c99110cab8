"""The rows of the boosted head: history and holdout without moving a row twice."""

from pyspark.sql import functions as F

from cohortloom.operators import history as H
from cohortloom.operators import splits as S
from cohortloom.plans import records as P


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_holdout_is_cut_off_in_place(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 3 == 0).cast("int").alias("hot"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    out = P._holdout(rows)
    numbered = S.stratified_split(rows.filter("split = 'train'").drop("split"), "hot", "o_orderkey", 0.1, 7)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, numbered.select(out.columns).collect()))
    assert "hashpartitioning" not in _plan(out)


def test_visits_meet_their_own_history_once(spark):
    v = spark.range(400).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"),
        F.when(F.col("id") % 11 > 0, F.timestamp_seconds(F.col("id") % 40 * 1000)).alias("o_orderdate"))
    out = P._with_history(v)
    two = H.prior_measures(v, v.select("o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", {"n_prior": ("sum", F.lit(1).cast("bigint"))})
    assert sorted(out.collect()) == sorted(two.select(out.columns).collect(), key=lambda r: r[0])
    assert "Union" not in _plan(out)


def test_subjects_are_counted_only_in_crowded_buckets(spark, monkeypatch):
    v = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 100).alias("s"), F.timestamp_seconds("id").alias("t"))
    find = lambda: sorted(map(tuple, H.prior_measures(v, v, "s", "t", {"n": ("sum", F.lit(1).cast("bigint"))}).collect()))
    apart = find()
    monkeypatch.setattr(H, "_CROWDS", 1)  # one crowded bucket without a common subject
    monkeypatch.setattr(H, "HOT", 3)
    assert find() == apart
    monkeypatch.setattr(H, "HOT", 2)  # and all subjects common
    assert find() == apart
