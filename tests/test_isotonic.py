"""Isotonic maps fitted in pieces, against MLlib and a plain definition."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from cohortloom.operators import heads
from cohortloom.operators.isotonic import IsotonicMap, fit_blocks, fit_map


def plain(points):
    """Value at each distinct score: the largest over starts of the least mean over ends."""
    xs = sorted({x for x, _, _ in points})
    s = {x: (sum(y * w for p, y, w in points if p == x), sum(w for p, _, w in points if p == x)) for x in xs}
    mean = lambda j, k: sum(s[x][0] for x in xs[j:k + 1]) / sum(s[x][1] for x in xs[j:k + 1])
    return {x: max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "level", "one"])
def test_blocks_equal_the_definition(spark, shape):
    rng = random.Random(shape)
    label = {"noise": lambda i: rng.random(), "rising": lambda i: i, "falling": lambda i: -i, "level": lambda i: 1, "one": lambda i: i % 2}[shape]
    points = [(0.5 if shape == "one" else (i % 40) / 40, float(label(i % 40)), float(1 + i % 3)) for i in range(60)]
    df = spark.createDataFrame(points, "s double, y double, w double")
    want = plain(points)
    for ranges in (1, 5, 40):
        blocks = [tuple(r) for r in fit_blocks(df, "s", "y", "w", ranges=ranges).orderBy("lo").collect()]
        values = [b[2] for b in blocks]
        assert all(a < b for a, b in zip(values, values[1:])) and sum(b[3] for b in blocks) == sum(p[2] for p in points)
        for x, value in want.items():
            assert [b[2] for b in blocks if b[0] <= x <= b[1]] == [pytest.approx(value, abs=1e-12)], (ranges, x)


def test_equals_mllib_and_both_ways_of_applying(spark):
    df = spark.range(6000).select((F.pmod(F.xxhash64("id"), F.lit(5000)) / 5000).alias("s"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).alias("r")) \
        .withColumn("y", (F.col("r") < F.sqrt("s") * 1000).cast("int"))
    model = IsotonicRegression(featuresCol="s", labelCol="y").fit(df.withColumn("s", F.col("s").cast("double")))
    own = fit_map(df, "s", "y")
    asked = spark.createDataFrame([(i, i / 777 - 0.1, "x") for i in range(1000)] + [(-1, None, "x"), (-2, math.nan, "x"), (-3, 0.5, None), (-3, 0.5, None)],
                                  "id long, s double, __edge_ string")
    want = {r.id: r.prediction for r in model.transform(asked.where("id >= 0")).collect()}
    for sent in (100_000, 3):
        got = own.apply(asked, "s", "p", sent)
        assert got.columns == [*asked.columns, "p"] and got.count() == asked.count()
        rows = got.collect()
        assert all(r.p == pytest.approx(want[r.id], abs=1e-9) for r in rows if r.id >= 0)
        assert [r.p for r in rows if r.id in (-1, -2)] == [None, None]
        falls = [r.p for r in sorted((r for r in rows if r.id >= 0), key=lambda r: r.s)]
        assert falls == sorted(falls)


def test_odd_rows_and_groups(spark):
    rows = [(None, 1, "a"), (0.1, None, "a"), (math.nan, 1, "a"), (0.2, 1, "a"), (0.3, 0, "a"), (0.2, 1, None), (-math.inf, 0, "b"), (math.inf, 1, "b")]
    df = spark.createDataFrame(rows, "s double, y int, g string")
    found = {(r.g, r.lo, r.hi, r.value, r.weight) for r in fit_blocks(df, "s", "y", by=["g"]).collect()}
    assert found == {("a", 0.2, 0.3, 0.5, 2.0), (None, 0.2, 0.2, 1.0, 1.0), ("b", -math.inf, -math.inf, 0.0, 1.0), ("b", math.inf, math.inf, 1.0, 1.0)}
    none = fit_blocks(df.where("s > 9 AND y > 9"), "s", "y")
    assert none.count() == 0 and [r.p for r in IsotonicMap(none).apply(df, "s", "p").collect()] == [None] * len(rows)


def test_one_against_the_rest_are_single_fits(spark):
    df = spark.range(300).select((F.col("id") % 3).cast("int").alias("y"), F.array(*[
        F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100)) / 100 for k in range(3)]).alias("p"))
    for k, one in enumerate(heads.calibrate_ovr(df, "p", "y", 3)):
        alone = heads.calibrate_isotonic(df.select(F.get("p", F.lit(k)).alias("s"), (F.col("y") == k).cast("int").alias("t")), "s", "t")
        assert (one.boundaries, one.predictions) == (alone.boundaries, alone.predictions)
