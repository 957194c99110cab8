"""Headline queries at one scale factor; prints one JSON line.

Each query is planned and run in full (its rows are collected as Arrow batches in the JVM's noop
sink). ``BENCH_QUERIES`` (comma list) narrows the set, ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data
and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from cohortloom.plans import QUERIES
from cohortloom.session import build_session, local_checkpoint_dir

HEADLINE = [
    "prior_order_history", "history_block", "last_prior_payload", "cohort_join", "semi_scan", "one_per_key",
    "mode_group_per_part", "summary_stats", "series_stats", "longitudinal_block", "reading_sequence", "normalize_docs",
    "negated_flags", "tfidf_vocab", "tfidf_weights", "token_prior_apply", "med_block", "rank_blend3", "flat_top10",
    "weight_grid", "oracle_recall", "threshold_sweep", "visit_ranking", "calibration_bins", "ordinal_report",
    "subgroup_report", "stratified_split", "score_modes", "training_table", "nested_split", "median_impute", "pareto_three",
    "note_records", "phrase_flags", "loader_parity", "soft_cascade_head", "binary_head_gate", "calibrated_classes", "importance_groups",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("OFF")
    local_checkpoint_dir(spark)
    spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
