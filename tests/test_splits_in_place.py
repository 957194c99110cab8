"""The split by a cut against the split by numbered rows."""

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import splits as S


@pytest.mark.parametrize("frac", [0.0, 0.2, 0.5, 1.0])
def test_same_rows_and_no_row_moved(spark, frac):
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") == 7, 9).otherwise(F.col("id") % 3).alias("y"))
    out = S.split_in_place(df, "y", "k", frac, 5)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, S.stratified_split(df, "y", "k", frac, 5).select("k", "y", "split").collect()))
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
