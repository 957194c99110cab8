"""Bucketed prefix totals against brute force, with one key holding most rows."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.operators.prefix import exact_quantiles, number_rows, value_buckets, with_prior


def _brute(rows):
    out = {}
    for k, t, v in rows:
        before = [x for kk, tt, x in rows if kk == k and tt < t]
        out[(k, t)] = (sum(before) if before else None, max(before) if before else None)
    return out


def test_with_prior_skewed_key(spark):
    rng = random.Random(1)
    rows = [("hot", float(i) * rng.choice([0.001, 1, 1000]) + i, rng.randint(-5, 5)) for i in range(300)]
    rows += [("cold", -1.5, 2), ("cold", 0.0, 3), ("cold", 1e9, 4)]
    rows = list({(k, t): (k, t, v) for k, t, v in rows}.values())
    df = spark.createDataFrame(rows, "k string, t double, v int")
    got = with_prior(df, ["k"], ["t"], value_buckets("t"), {"s": ("sum", "v"), "m": ("max", "v")}).collect()
    want = _brute(rows)
    assert len(got) == len(rows)
    assert all((r.s, r.m) == want[(r.k, r.t)] for r in got)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, values):
    import numpy as np
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_quantiles(df, ["v"], {"median": 0.5, "q1": 0.25}).first()
    assert abs(row["median"] - np.median(values)) <= 1e-9 * max(1, abs(np.median(values)))
    assert abs(row["q1"] - np.quantile(values, 0.25)) <= 1e-6


def test_number_rows_counts_every_row(spark):
    df = spark.range(500).select((F.col("id") % 7 == 0).cast("int").alias("k"), "id")
    got = number_rows(df, ["k"], ["id"], [F.floor(F.col("id") / 50)]).groupBy("k").agg(
        F.min("row_no").alias("lo"), F.max("row_no").alias("hi"), F.countDistinct("row_no").alias("n")).collect()
    assert {r.k: (r.lo, r.hi, r.n) for r in got} == {1: (1, 72, 72), 0: (1, 428, 428)}
