"""The pipeline against plain versions of its stages."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from cohortloom.session import durable  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = durable(spark.read.parquet(f"{SF}/documents.parquet"))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(durable(stage(spark, out[-1], SF)))
    return out


def test_columns(stages):
    assert all(s.columns == list(corpus_pipeline.COLUMNS) for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


def test_stages(spark, stages):
    first, calm, single, clean, redacted, packed = ([tuple(r) for r in s.collect()] for s in stages)
    assert set(calm) <= set(first) and len(calm) > 0.8 * len(first)
    pairs = [(r[0], r[1]) for r in calm]
    keep = {d for (d, _), (_, c) in zip(pairs, brute.near(pairs)) if d == c}
    assert sorted(single) == sorted(r for r in calm if r[0] in keep)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {w[0]: w for w in brute.contamination([(r[0], r[1]) for r in single], items)}
    after = {w[0]: w for w in brute.contamination([(r[0], r[1]) for r in clean], items)}
    old = {r[0]: r for r in single}
    for r in clean:
        n = before[r[0]][1] - before[r[0]][2]
        assert after[r[0]][1] == n and (before[r[0]][5] or r == old[r[0]])
    old = {r[0]: r for r in clean}
    for r in redacted:
        spans = brute.secrets(old[r[0]][1])
        assert (r[1] == old[r[0]][1]) == (not spans) or "[SECRET]" in r[1] or "[EXAMPLE-SECRET]" in r[1]
        assert not brute.secrets(r[1]) and r[4] == len(r[1])
    assert {r[0] for r in packed} == {r[0] for r in redacted}


def test_run(spark, stages):
    cols = ("doc_id", "piece", "start", "length", "ids_crc32")
    got = sorted(tuple(r[c] for c in cols) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(tuple(r[c] for c in cols) for r in stages[-1].collect())


def test_odd_rows(spark, stages):
    """Nulls in every column, repeated rows and columns that clash go through; a null text stays null until packing."""
    rows = [(None, None, None, None, None), (1, "plain text of some words", "en", "s", 24), (1, "plain text of some words", "en", "s", 24),
            (2, "", "en", None, 0), (3, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_row", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, SF))
    assert {r.doc_id for r in docs.collect()} == {None, 1, 2}
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        none = durable(stage(spark, none, SF))
    assert none.count() == 0
