"""Queries that put the blocks together: the training table of visits and the exact checks of the model heads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import heads as D
from ..operators import joins as J
from ..session import durable
from .encounters import history_block, longitudinal_block
from .records import _calibrated, calibrated_classes, importance_groups, soft_cascade_head
from .registry import ORACLE, VISITS, query, r6, table, visits
from .texts import DOC_VOCAB, PART_NAMES, med_block, negated_flags

_HISTORY = ["pmh_big", "n_prior_admissions", "n_prior_ed_visits", "days_since_last_admission", "days_since_last_ed",
            "same_complaint_as_prior", "no_history"]
_VITALS = ["heartrate_min", "heartrate_max", "heartrate_last", "heartrate_delta", "n_tachycardia_readings",
           "n_bradycardia_readings", "rhythm_irregular", "rhythm_sinus", "rhythm_sinus_tachy", "has_longitudinal_vitals"]
_MEDS = ["n_medications", "meds_unknown", *PART_NAMES]
_TEXT = list(DOC_VOCAB)
_ZERO = [c for c in _VITALS if c not in ("heartrate_min", "heartrate_max", "heartrate_last")]
_INTS = [c for c in _ZERO if c.startswith(("rhythm", "has_"))] + ["meds_unknown", *PART_NAMES, *_TEXT]


def _filled(col: str) -> str:
    default = {"meds_unknown": "1"}.get(col, "0")
    kind = "INTEGER" if col in _INTS else "DOUBLE" if col == "heartrate_delta" else "BIGINT"
    return f"CAST(coalesce({col}, {default}) AS {kind}) AS {col}"


@query("training_table", f"""
WITH {VISITS}, h AS ({ORACLE['history_block']}), w AS ({ORACLE['longitudinal_block']}), m AS ({ORACLE['med_block']}), t AS ({ORACLE['negated_flags']})
SELECT o_orderkey, c_mktsegment, acuity, {', '.join(_HISTORY)}, heartrate_min, heartrate_max, heartrate_last, {', '.join(map(_filled, [*_ZERO, *_MEDS, *_TEXT]))},
  CAST(CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS has_note, admitted
FROM v JOIN customer ON o_custkey = c_custkey JOIN h ON h.stay_id = o_orderkey LEFT JOIN w ON w.user_id = o_custkey LEFT JOIN m ON m.l_orderkey = o_orderkey
  LEFT JOIN t ON t.doc_id = o_orderkey WHERE acuity IS NOT NULL""")
def training_table(spark, sf):
    """One row per visit: cohort, cleaning, history, window vitals, medications, note flags and label.

    Every block comes from its own operator in full; blocks a visit lacks take their defaults."""
    cohort = J.join_on(
        visits(spark, sf).where("acuity IS NOT NULL"),
        table(spark, sf, "customer", "c_custkey", "c_mktsegment").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])
    out = J.join_on(cohort, history_block(spark, sf).withColumnRenamed("stay_id", "o_orderkey"), ["o_orderkey"])
    out = J.left_child(out, longitudinal_block(spark, sf).withColumnRenamed("user_id", "o_custkey"), "o_custkey")
    out = J.left_child(out, med_block(spark, sf).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    notes = negated_flags(spark, sf).withColumnRenamed("doc_id", "o_orderkey").withColumn("has_note", F.lit(1))
    out = J.left_child(out, notes, "o_orderkey")
    out = out.fillna({"meds_unknown": 1}).fillna(0, [*_ZERO, *_MEDS, *_TEXT, "has_note"])
    return C.assemble(out, {"cohort": ["c_mktsegment", "acuity"], "history": _HISTORY, "vitals": _VITALS, "medications": _MEDS,
                            "text": [*_TEXT, "has_note"], "label": ["admitted"]}, ["o_orderkey"])


# --- exact properties of the heads ---------------------------------------------------------------------


@query("soft_cascade_checks", """
SELECT count(*) AS n, CAST(0 AS BIGINT) AS bad_sums, CAST(0 AS BIGINT) AS bad_class FROM (
  SELECT row_number() OVER (PARTITION BY hot ORDER BY md5('42|' || o_orderkey), o_orderkey) AS pos, count(*) OVER (PARTITION BY hot) AS k FROM (
    SELECT o_orderkey, CASE WHEN o_totalprice > 300000 OR substr(o_orderpriority, 1, 1) = '1' THEN 1 ELSE 0 END AS hot FROM orders))
WHERE pos <= floor(0.2::DOUBLE * k + 0.5)""")
def soft_cascade_checks(spark, sf):
    """Every test row is scored once; probabilities sum to 1 and the class is one with the highest."""
    p = [F.col(f"p_level_{i}") for i in range(5)]
    out = soft_cascade_head(spark, sf)
    total = p[0] + p[1] + p[2] + p[3] + p[4]
    own = F.element_at(F.array(*p), F.col("level_pred").cast("int") + 1)
    return out.agg(F.count("*").alias("n"), F.count_if(F.abs(total - 1) > 1e-5).alias("bad_sums"),
                   F.count_if(own < F.greatest(*p) - 1e-6).alias("bad_class"))


@query("gate_checks", """
SELECT CAST(0 AS BIGINT) AS below, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS falls,
  true AS some, true AS fits""")
def gate_checks(spark, sf):
    """Gated rows reach the threshold, occur once and none is lost; calibrated scores are rates, never fall where the score
    rises, and come closer to the labels than the share of all rows does."""
    scored = durable(_calibrated(spark, sf).select("o_orderkey", "hot", "p1", "p_cal"))
    g = D.gate(scored, "p_cal")
    gated = g.agg(F.count_if(F.col("p_cal") < 0.4).alias("below"), (F.count("*") - F.count_distinct("o_orderkey")).alias("repeated"),
                  (F.count("*") > 0).alias("some"))
    share = scored.agg(F.avg("hot")).first()[0]
    whole = scored.agg(F.count_if((F.col("p_cal") < 0) | (F.col("p_cal") > 1)).alias("outside"), (
        F.avg((F.col("p_cal") - F.col("hot")) ** 2) < 0.9 * share * (1 - share)).alias("fits"))
    lost = scored.where("p_cal >= 0.4").join(g, "o_orderkey", "left_anti").agg(F.count("*").alias("lost"))
    values = scored.groupBy("p_cal").agg(F.min("p1").alias("least"), F.max("p1").alias("most"))  # one row per leaf sum
    before = F.max("most").over(Window.orderBy("p_cal").rowsBetween(Window.unboundedPreceding, -1))
    falls = values.withColumn("before", before).agg(F.count_if(F.col("before") > F.col("least")).alias("falls"))
    found = gated
    for one in (whole, lost, falls):  # one row each
        found = found.unionByName(one, allowMissingColumns=True)
    return found.agg(*[F.max(c).alias(c) for c in ("below", "repeated", "outside", "lost", "falls", "some", "fits")])


@query("calibration_checks", """
SELECT count(*) AS n, true AS ordered, true AS rates FROM (
  SELECT row_number() OVER (PARTITION BY label ORDER BY md5('3|' || vec_id), vec_id) AS pos, count(*) OVER (PARTITION BY label) AS k FROM embeddings)
WHERE pos > floor(0.5::DOUBLE * k + 0.5)""")
def calibration_checks(spark, sf):
    """The rows that the isotonic maps did not see, and hit rates that rise with the number of guesses."""
    out = calibrated_classes(spark, sf, held="train")
    return out.select("n", ((F.col("top1") <= F.col("top3")) & (F.col("top3") <= F.col("top5"))).alias("ordered"),
                      ((F.col("mrr") >= F.col("top1")) & (F.col("mrr") <= 1)).alias("rates"))


@query("importance_checks", "SELECT CAST(3 AS BIGINT) AS n_groups, CAST(100 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS negative")
def importance_checks(spark, sf):
    """Gain shares of all groups add up to one hundred."""
    out = importance_groups(spark, sf)
    return out.agg(F.count("*").alias("n_groups"), r6(F.sum("pct"), 3).alias("total"), F.count_if(F.col("pct") < 0).alias("negative"))
