"""Queries of the case layer: splits, samples, bundles, audits, caches and model heads."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import cases as N
from ..operators import heads as D
from ..operators import history as H
from ..operators import metrics as M
from ..operators import readings as G
from ..operators import retrieval as T
from ..operators import splits as S
from ..operators import vectors as W
from ..operators.aggregates import class_weights
from ..operators.isotonic import fit_map
from ..operators.joins import within_window
from ..session import checkpoint_dir, durable
from ..sources import cached_features, materialize, read_cases, read_optional, write_cases, write_report
from .cohort import sql_normalize
from .encounters import _anchors
from .evaluate import _scores
from .registry import R, VISITS, query, r6, rounded, table, visits


def _pos(strata: str, key: str, seed: int) -> str:
    return f"row_number() OVER (PARTITION BY {strata} ORDER BY md5('{seed}|' || {key}), {key})"


# --- splits ------------------------------------------------------------------------------------------


@query("stratified_split", f"""
SELECT o_orderkey, CASE WHEN pos <= floor(0.2::DOUBLE * n + 0.5) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT o_orderkey, {_pos('o_orderpriority', 'o_orderkey', 42)} AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""")
def stratified_split(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderpriority")
    return S.stratified_split(o, "o_orderpriority", "o_orderkey").select("o_orderkey", "split")


@query("nested_split", f"""
WITH a AS (SELECT o_orderkey, o_orderstatus, {_pos('o_orderstatus', 'o_orderkey', 42)} AS pos, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
b AS (SELECT *, {_pos('o_orderstatus', 'o_orderkey', 7)} AS pos2, count(*) OVER (PARTITION BY o_orderstatus) AS n2 FROM a WHERE pos > floor(0.2::DOUBLE * n + 0.5)),
c AS (SELECT *, {_pos('o_orderstatus', 'o_orderkey', 8)} AS pos3, count(*) OVER (PARTITION BY o_orderstatus) AS n3 FROM b WHERE pos2 > floor(0.1::DOUBLE * n2 + 0.5))
SELECT o_orderkey, 'test' AS split FROM a WHERE pos <= floor(0.2::DOUBLE * n + 0.5) UNION ALL SELECT o_orderkey, 'calibration' FROM b WHERE pos2 <= floor(0.1::DOUBLE * n2 + 0.5)
UNION ALL SELECT o_orderkey, CASE WHEN pos3 <= floor(0.2::DOUBLE * n3 + 0.5) THEN 'validation' ELSE 'train' END FROM c""")
def nested_split(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    return S.nested_split(o, "o_orderstatus", "o_orderkey", {"calibration": (0.1, 7), "validation": (0.2, 8)}).select("o_orderkey", "split")


@query("stratified_cap", f"""
SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority, {_pos('o_orderpriority', 'o_orderkey', 42)} AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER () AS t FROM orders)
WHERE pos <= floor(500.0::DOUBLE * n / greatest(t, 500) + 0.5)""")
def stratified_cap(spark, sf):
    return S.stratified_cap(table(spark, sf, "orders", "o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 500)


@query("sample_strata", f"""
SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus, {_pos('o_orderstatus', 'o_orderkey', 11)} AS pos FROM orders WHERE o_orderstatus IN ('F', 'O'))
WHERE (o_orderstatus = 'F' AND pos <= 100) OR (o_orderstatus = 'O' AND pos <= 150)""")
def sample_strata(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    return S.sample_strata(o, "o_orderstatus", "o_orderkey", {"F": 100, "O": 150}, seed=11)


@query("loader_parity", """
WITH full_l AS (SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey), light AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority <> '3-MEDIUM')
SELECT (SELECT count(*) FROM (SELECT * FROM full_l EXCEPT ALL SELECT * FROM light)) AS n_only_a, (SELECT count(*) FROM (SELECT * FROM light EXCEPT ALL SELECT * FROM full_l)) AS n_only_b""")
def loader_parity(spark, sf):
    """Full loader against one that wrongly drops a level: the rows only one side has."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    full = o.join(table(spark, sf, "customer", "c_custkey").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    light = o.filter("o_orderpriority <> '3-MEDIUM'")
    return S.content_difference(full.select("o_orderkey", "o_custkey"), light.select("o_orderkey", "o_custkey"))


# --- cases -------------------------------------------------------------------------------------------


@query("case_bundle", """
WITH nm AS (SELECT l_orderkey, string_agg(p_name, ', ' ORDER BY rn) AS names FROM (SELECT l_orderkey, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY f) AS rn FROM (
  SELECT l_orderkey, p_name, min((l_linenumber, p_name)) AS f FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)) WHERE rn <= 15 GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS admitted, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS acuity,
  coalesce(names, '') AS medications FROM orders LEFT JOIN nm ON o_orderkey = l_orderkey""")
def case_bundle(spark, sf):
    """One case record per visit; its readings are ``case_readings``."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber") \
        .join(table(spark, sf, "part", "p_partkey", "p_name").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    names = T.distinct_names(lines, ["l_orderkey"], ["l_linenumber"], "p_name", 15).withColumnRenamed("l_orderkey", "o_orderkey")
    out = N.case_bundle(visits(spark, sf), names, "o_orderkey", ["acuity", "admitted"], ["o_orderpriority", "score"])
    return out.select("o_orderkey", "ground_truth.admitted", "ground_truth.acuity",
                      F.col("nurse_inputs.medications_raw").alias("medications"))


@query("case_readings", """
WITH a AS (SELECT user_id, min(ts) AS intime FROM events WHERE event_type = 'signup' GROUP BY 1),
w AS (SELECT e.user_id, e.event_id, e.ts, e.value FROM events e JOIN a ON e.user_id = a.user_id AND e.ts >= a.intime AND e.ts <= a.intime + INTERVAL 24 HOUR),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM w)
SELECT user_id, (rn - 1) // 1000 AS part_no, string_agg(CAST(round(value * 100) AS BIGINT), ',' ORDER BY rn) AS seq FROM s GROUP BY 1, 2""")
def case_readings(spark, sf):
    events = table(spark, sf, "events", "event_id", "user_id", "ts", "value")
    inside = within_window(events, _anchors(spark, sf), "user_id", "ts", "intime", 24)
    arrays = G.reading_arrays(G.reading_sequence(inside, ["user_id"], "ts", "event_id", "value"), ["user_id"], "value")
    cents = F.transform("value", lambda v: F.round(v * 100).cast("bigint").cast("string"))
    return arrays.select("user_id", "part_no", F.array_join(cents, ",").alias("seq"))


# A narrative per turn: stated age and pain, a clinical slip in some turns, then the turn's own text. Word bounds in the
# SQL engine know ASCII letters only, so its text (not ours) shows other letters as x and other signs as blanks.
_NARR = """n AS (SELECT conv_id, turn, role, 20 + conv_id % 60 AS age, turn % 11 AS pain, CASE WHEN conv_id % 2 = 0 THEN 'chest pain, fever' ELSE 'odd feeling' END AS complaints,
  'I am ' || (20 + conv_id % 60 + CASE WHEN turn = 2 THEN 1 ELSE 0 END) || ' years old, pain ' || (turn + 1) % 11 || ' out of 10. ' ||
  CASE turn % 4 WHEN 0 THEN 'My bp was 120/80. ' WHEN 1 THEN 'I had Dyspnea and SOB. ' WHEN 2 THEN 'It hurts, I am hot. ' ELSE 'temp of 101. ' END ||
  regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{L}\\p{N}]', ' ', 'g'), '[^\\x00-\\x7F]', 'x', 'g') AS t FROM conversations)"""
_AGE1, _AGE2 = (p.replace("'", "''") for p in N.AGE_PATTERNS)


_AUDIT = f"""{_NARR}, x AS (SELECT *, list_filter(list_concat(regexp_extract_all(t, '{_AGE1}', 1), regexp_extract_all(t, '{_AGE2}', 1)), lambda a: CAST(a AS INTEGER) <> age) AS ages,
  list_filter(regexp_extract_all(t, '{N.PAIN_PATTERN}', 1), lambda p: CAST(p AS INTEGER) <> pain) AS pains, lower(t) AS l FROM n),
y AS (SELECT conv_id, turn, role, len(ages) AS bad_ages, len(pains) AS bad_pains, CAST(regexp_matches(t, '{N.PRESSURE_PATTERN}') AS INTEGER) AS bp, CAST(regexp_matches(t, '{N.MEASURE_PATTERN}') AS INTEGER) AS ms,
  CAST(regexp_matches(t, '{N.JARGON_PATTERN}') AS INTEGER) AS jg, CASE WHEN complaints LIKE 'chest%' AND NOT (regexp_matches(l, 'chest|pain|hurt|ache|sore|killing') AND regexp_matches(l, 'fever|temperature|burning up|chills|hot')) THEN 1 ELSE 0 END AS dr FROM x)"""


@query("grounding_audit", f"""WITH {_AUDIT}
SELECT conv_id, turn, CAST(bad_ages + bad_pains + bp + ms + jg + dr AS INTEGER) AS n_reasons, CAST(CASE WHEN bad_ages + bad_pains + bp + ms + jg + dr = 0 THEN 1 ELSE 0 END AS INTEGER) AS grounded FROM y""")
def grounding_audit(spark, sf):
    return _audited(spark, sf).select("conv_id", "turn", F.size("reasons").alias("n_reasons"), "grounded")


def _audited(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    age, told = (F.col("conv_id") % 60 + 20).cast("int"), F.when(F.col("turn") == 2, 1).otherwise(0)
    slip = F.when(F.col("turn") % 4 == 0, "My bp was 120/80. ").when(F.col("turn") % 4 == 1, "I had Dyspnea and SOB. ") \
        .when(F.col("turn") % 4 == 2, "It hurts, I am hot. ").otherwise("temp of 101. ")
    text = F.concat(F.lit("I am "), (age + told).cast("string"), F.lit(" years old, pain "), ((F.col("turn") + 1) % 11).cast("string"),
                    F.lit(" out of 10. "), slip, F.col("text"))
    rows = c.select("conv_id", "turn", "role", age.alias("age"), (F.col("turn") % 11).cast("int").alias("pain"), text.alias("narrative"),
                    F.when(F.col("conv_id") % 2 == 0, "chest pain, fever").otherwise("odd feeling").alias("complaints"))
    return N.grounding_audit(rows, "narrative", "age", "pain", "complaints")


@query("grounding_pass_rate", f"""WITH {_AUDIT}, z AS (SELECT role, turn, CASE WHEN bad_ages + bad_pains + bp + ms + jg + dr = 0 THEN 1 ELSE 0 END AS ok FROM y)
SELECT role, count(*) AS n, sum(ok)::BIGINT AS clean, (count(*) - sum(ok))::BIGINT AS flagged, {R('avg(ok)')} AS pass_rate, {R('avg(turn + 1)')} AS mean_attempts FROM z GROUP BY 1""")
def grounding_pass_rate(spark, sf):
    """Audit outcome per role, the number of tries standing in the turn number."""
    rows = _audited(spark, sf).withColumn("attempts", F.col("turn") + 1)
    return rounded(N.pass_rate(rows, "role", "grounded", "attempts"), "pass_rate", "mean_attempts")


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_TRUTH = f"""{VISITS}, pl AS (SELECT l_orderkey, min((l_linenumber, l_partkey)) AS f FROM lineitem GROUP BY 1),
tr AS (SELECT v.o_orderkey, acuity, admitted, p_type AS diagnosis_group, c_mktsegment AS service_group, CASE WHEN p_size > 5 THEN p_brand END AS icd_true
  FROM v LEFT JOIN pl ON v.o_orderkey = l_orderkey LEFT JOIN part ON f[2] = p_partkey LEFT JOIN customer ON o_custkey = c_custkey),
md AS (SELECT unnest(['vectors', 'parsed']) AS mode, unnest([0, 1]) AS sh),
ps AS (SELECT o_orderkey, mode, CASE WHEN sh = 1 AND o_orderkey % 5 = 0 THEN NULL ELSE acuity_pred END AS acuity_pred, CASE WHEN score >= 0.4 + 0.1 * sh THEN 1 ELSE 0 END AS admit_pred,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE list_transform([0, 1, 2], lambda i: [{', '.join(repr(t) for t in _TYPES)}][1 + CAST((o_orderkey + i + sh) % 6 AS INTEGER)]) END AS diag_top3,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE list_transform([0, 1, 2], lambda i: [{', '.join(repr(t) for t in _SEGS)}][1 + CAST((o_orderkey + i) % 5 AS INTEGER)]) END AS dept_top3,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE list_transform(range(0, 10), lambda i: 'Brand#' || ((o_orderkey + i * 3 + sh) % 25 + 1)) END AS icd_flat FROM v, md WHERE o_orderkey % 11 <> sh)"""


def _case_truth(spark, sf):
    v = visits(spark, sf)
    first = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min(F.struct("l_linenumber", "l_partkey")).getField("l_partkey").alias("p_partkey"))
    part = table(spark, sf, "part", "p_partkey", "p_type", "p_brand", "p_size")
    cust = table(spark, sf, "customer", "c_custkey", "c_mktsegment").withColumnRenamed("c_custkey", "o_custkey")
    rows = v.join(first, "o_orderkey", "left").join(part, "p_partkey", "left").join(cust, "o_custkey", "left")
    return rows.select("o_orderkey", "acuity", "admitted", F.col("p_type").alias("diagnosis_group"), F.col("c_mktsegment").alias("service_group"),
                       F.when(F.col("p_size") > 5, F.col("p_brand")).alias("icd_true"))


def _mode_preds(spark, sf):
    k, sh = F.col("o_orderkey"), F.col("sh")
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(i).alias("sh")) for i, m in enumerate(["vectors", "parsed"])])
    v = visits(spark, sf).select("*", F.explode(modes).alias("m")).select("*", "m.*").filter(k % 11 != sh)
    pick = lambda levels, off: F.get(F.array(*[F.lit(x) for x in levels]), ((k + off) % len(levels)).cast("int"))
    some = lambda arr: F.when(k % 4 != 0, arr)
    return v.select(
        "o_orderkey", "mode", F.when(~((sh == 1) & (k % 5 == 0)), F.col("acuity_pred")).alias("acuity_pred"),
        (F.col("score") >= F.lit(0.4) + F.lit(0.1) * sh).cast("int").alias("admit_pred"),
        some(F.array(*[pick(_TYPES, sh + i) for i in range(3)])).alias("diag_top3"), some(F.array(*[pick(_SEGS, i) for i in range(3)])).alias("dept_top3"),
        some(F.array(*[F.concat(F.lit("Brand#"), ((k + i * 3 + sh) % 25 + 1).cast("string")) for i in range(10)])).alias("icd_flat"))


_ELIG = "admitted = 1 AND diagnosis_group IS NOT NULL"
_CODED = f"{_ELIG} AND icd_true IS NOT NULL"


def _hit(cond: str, arr: str, val: str, k: int) -> str:
    return R(f"avg(CASE WHEN {cond} THEN CASE WHEN list_contains(coalesce({arr}, [])[1:{k}], {val}) THEN 1 ELSE 0 END END)")


@query("score_modes", f"""WITH {_TRUTH}, j AS (SELECT * FROM tr JOIN ps USING (o_orderkey))
SELECT mode, {R('avg(CASE WHEN acuity_pred IS NOT NULL THEN CASE WHEN acuity_pred = acuity THEN 1 ELSE 0 END END)')} AS acuity, {R('avg(CASE WHEN admit_pred = admitted THEN 1 ELSE 0 END)')} AS dispo,
  {_hit(_ELIG, 'diag_top3', 'diagnosis_group', 1)} AS diag_top1, {_hit(_ELIG, 'diag_top3', 'diagnosis_group', 3)} AS diag_top3, {_hit(_ELIG, 'dept_top3', 'service_group', 1)} AS dept_top1, {_hit(_ELIG, 'dept_top3', 'service_group', 3)} AS dept_top3,
  {_hit(_CODED, 'icd_flat', 'icd_true', 1)} AS icd_top1, {_hit(_CODED, 'icd_flat', 'icd_true', 5)} AS icd_top5, {_hit(_CODED, 'icd_flat', 'icd_true', 10)} AS icd_top10,
  count(CASE WHEN {_ELIG} AND diag_top3 IS NOT NULL THEN 1 END) AS diag_cov, count(CASE WHEN {_ELIG} AND dept_top3 IS NOT NULL THEN 1 END) AS dept_cov, count(CASE WHEN {_ELIG} THEN 1 END) AS n_admit,
  count(CASE WHEN {_CODED} AND icd_flat IS NOT NULL THEN 1 END) AS icd_cov, count(CASE WHEN {_CODED} THEN 1 END) AS icd_n FROM j GROUP BY 1""")
def score_modes(spark, sf):
    out = N.score_modes(_case_truth(spark, sf), _mode_preds(spark, sf), "o_orderkey")
    return rounded(out, *[c for c in out.columns if c.split("_")[0] in ("acuity", "dispo") or "_top" in c])


@query("audit_long", f"""WITH {_TRUTH}, j AS (SELECT * FROM tr JOIN ps USING (o_orderkey)),
a AS (SELECT o_orderkey, mode, 'acuity' AS head, acuity::VARCHAR AS truth, acuity_pred::VARCHAR AS pred, acuity_pred - acuity AS signed_error FROM j WHERE acuity_pred IS NOT NULL
  UNION ALL SELECT o_orderkey, mode, 'disposition', admitted::VARCHAR, admit_pred::VARCHAR, NULL FROM j
  UNION ALL SELECT o_orderkey, mode, 'diagnosis', diagnosis_group, diag_top3[1], NULL FROM j WHERE {_ELIG} AND diag_top3 IS NOT NULL
  UNION ALL SELECT o_orderkey, mode, 'department', service_group, dept_top3[1], NULL FROM j WHERE {_ELIG} AND dept_top3 IS NOT NULL)
SELECT *, CAST(truth = pred AS INTEGER) AS correct FROM a""")
def audit_long(spark, sf):
    return N.audit_rows(_case_truth(spark, sf), _mode_preds(spark, sf), "o_orderkey")


@query("audit_wide", f"""WITH {_TRUTH}, j AS (SELECT * FROM tr JOIN ps USING (o_orderkey))
SELECT o_orderkey, max(CASE WHEN mode = 'vectors' THEN acuity_pred::VARCHAR END) AS acuity_vectors_pred, max(CASE WHEN mode = 'vectors' THEN CAST(acuity_pred = acuity AS INTEGER) END) AS acuity_vectors_ok,
  max(CASE WHEN mode = 'parsed' THEN acuity_pred::VARCHAR END) AS acuity_parsed_pred, max(CASE WHEN mode = 'parsed' THEN CAST(acuity_pred = acuity AS INTEGER) END) AS acuity_parsed_ok FROM j GROUP BY 1""")
def audit_wide(spark, sf):
    audit = N.audit_rows(_case_truth(spark, sf), _mode_preds(spark, sf), "o_orderkey")
    return N.wide_master(audit, "o_orderkey", ["vectors", "parsed"], ["acuity"])


# Parser audit: each turn's text is the truth, the next turn's the parse; fields drift by rule.
_FID = f"""f AS (SELECT a.conv_id * 1000 + a.turn AS case_id, list_distinct(list_filter(string_split({sql_normalize('a.text')}, ' '), lambda w: w <> '')) AS t,
  list_distinct(list_filter(string_split({sql_normalize('b.text')}, ' '), lambda w: w <> '')) AS u, {sql_normalize('a.text')} <> {sql_normalize('b.text')} AS rw, a.turn AS turn, a.conv_id AS c
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
k AS (SELECT *, len(list_intersect(t, u)) AS i, len(list_distinct(list_concat(t, u))) AS un, len(t) AS nt, len(u) AS nu FROM f),
pq AS (SELECT *, CASE WHEN nt = 0 AND nu = 0 THEN 1 WHEN nu = 0 THEN 0 ELSE i / nu END AS pr, CASE WHEN nt = 0 AND nu = 0 THEN 1 WHEN nt = 0 THEN 0 ELSE i / nt END AS rc FROM k)"""
_FID_COLS = ["complaint_jaccard_raw", "complaint_jaccard_used", "complaint_precision", "complaint_recall", "complaint_f1"]


def _fidelity(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    case = (F.col("conv_id") * 1000 + F.col("turn")).alias("case_id")
    truth = c.select(case, F.col("text").alias("complaints"), F.lit(40).alias("age"), F.lit("male").alias("gender"),
                     F.lit("walk_in").alias("transport"), F.col("turn").alias("pain"))
    parsed = c.select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("case_id"), F.col("text").alias("parsed_used"), F.col("turn"),
                      (F.lit(40) + F.col("conv_id") % 2).alias("parsed_age"), F.when(F.col("conv_id") % 3 == 0, "Female").otherwise("MALE").alias("parsed_gender"),
                      F.when(F.col("conv_id") % 5 == 0, "ambulance").otherwise("Walk in").alias("parsed_transport"), (F.col("turn") - 1).alias("parsed_pain")) \
        .filter("turn > 0").drop("turn")
    raw = c.select(case, F.col("text").alias("parsed_raw"))
    return N.fidelity(truth, parsed.join(raw, "case_id"), "case_id")


@query("parser_fidelity", f"""WITH {_FID} SELECT case_id, CAST(c % 2 = 0 AS INTEGER) AS age_ok, CAST(c % 3 <> 0 AS INTEGER) AS gender_ok, CAST(c % 5 <> 0 AS INTEGER) AS transport_ok, 1 AS pain_ok,
  1.0::DOUBLE AS complaint_jaccard_raw, {R('CASE WHEN un = 0 THEN 1 ELSE i / un END')} AS complaint_jaccard_used, {R('pr')} AS complaint_precision, {R('rc')} AS complaint_recall,
  {R('CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END')} AS complaint_f1, CAST(rw AS INTEGER) AS map_rewrote FROM pq""")
def parser_fidelity(spark, sf):
    return rounded(_fidelity(spark, sf), *_FID_COLS)


@query("fidelity_summary", f"""WITH {_FID} SELECT count(*) AS n, {R('avg(CAST(c % 2 = 0 AS INTEGER))')} AS age_ok, {R('avg(CAST(c % 3 <> 0 AS INTEGER))')} AS gender_ok, {R('avg(CAST(c % 5 <> 0 AS INTEGER))')} AS transport_ok,
  1.0::DOUBLE AS pain_ok, 1.0::DOUBLE AS complaint_jaccard_raw, {R('avg(CASE WHEN un = 0 THEN 1 ELSE i / un END)')} AS complaint_jaccard_used, {R('avg(pr)')} AS complaint_precision, {R('avg(rc)')} AS complaint_recall,
  {R('avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END)')} AS complaint_f1, {R('avg(CAST(rw AS INTEGER))')} AS map_rewrote FROM pq""")
def fidelity_summary(spark, sf):
    out = N.fidelity_summary(_fidelity(spark, sf), "case_id")
    return rounded(out, *[c for c in out.columns if c != "n"])


# --- stored results ----------------------------------------------------------------------------------


def _place(spark, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("optional_source", "SELECT o_orderstatus, count(*) AS n, 0::BIGINT AS n_notes FROM orders GROUP BY 1")
def optional_source(spark, sf):
    """A missing optional table joins as an empty one."""
    notes = read_optional(spark, f"{sf}/notes_that_do_not_exist.parquet", "o_orderkey bigint, note string")
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus").join(notes, "o_orderkey", "left")
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("note").alias("n_notes"))


_HIST = f"""SELECT a.o_custkey, count(*) AS n, {R('sum(a.o_totalprice)', 2)} AS total FROM orders a GROUP BY 1"""


@query("cached_features", f"{_HIST} HAVING a.o_custkey % 3 = 0")
def cached_features_query(spark, sf):
    """Some keys of a table of all: built on the first call, served from Parquet on the second."""
    o = table(spark, sf, "orders", "o_custkey", "o_totalprice")
    path, keys = _place(spark, "features"), o.filter("o_custkey % 3 = 0").select("o_custkey").distinct()
    build = lambda: o.groupBy("o_custkey").agg(F.count("*").alias("n"), r6(F.sum("o_totalprice"), 2).alias("total"))
    cached_features(spark, path, keys, ["o_custkey"], build)
    return cached_features(spark, path, keys, ["o_custkey"], lambda: build().limit(0))


@query("materialized_features", _HIST)
def materialized_features(spark, sf):
    """Versioned result: the second call finds the stored one by the digest of its source files."""
    o = table(spark, sf, "orders", "o_custkey", "o_totalprice")
    path = _place(spark, "versioned")
    build = lambda: o.groupBy("o_custkey").agg(F.count("*").alias("n"), r6(F.sum("o_totalprice"), 2).alias("total"))
    materialize(spark, path, [f"{sf}/orders.parquet"], "1", build)
    return materialize(spark, path, [f"{sf}/orders.parquet"], "1", lambda: build().limit(0))


@query("report_files", f"""WITH {VISITS} SELECT o_orderpriority, count(*) AS n, {R('avg(score)')} AS mean_score FROM v GROUP BY 1""")
def report_files(spark, sf):
    """CSV report written and read back."""
    path = _place(spark, "report")
    write_report(visits(spark, sf).groupBy("o_orderpriority").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean_score")), path)
    return spark.read.schema("o_orderpriority string, n bigint, mean_score double").option("header", True).csv(path)


@query("case_files", f"""WITH {VISITS} SELECT acuity, admitted, count(*) AS n, {R('sum(score)')} AS total FROM v GROUP BY 1, 2""")
def case_files(spark, sf):
    """Nested JSON case records written and read back."""
    path = _place(spark, "cases")
    write_cases(visits(spark, sf).select("o_orderkey", F.struct("acuity", "admitted").alias("ground_truth"), F.struct("score").alias("inputs")), path)
    back = read_cases(spark, path, "o_orderkey bigint, ground_truth struct<acuity:int,admitted:int>, inputs struct<score:double>")
    return back.groupBy("ground_truth.acuity", "ground_truth.admitted").agg(F.count("*").alias("n"), r6(F.sum("inputs.score")).alias("total"))


# --- model heads -------------------------------------------------------------------------------------


def _with_history(parted):
    """Number of earlier visits instead of subject and time; the visits are the history too, so each is moved once."""
    one = F.lit(1).cast("bigint")
    return H.prior_measures(parted, None, "o_custkey", "o_orderdate", {"n_prior": ("sum", one)}, own={"n_prior": one}) \
        .drop("o_custkey", "o_orderdate")


def _features(spark, sf):
    """Visits with amounts, line totals and history as numeric features, split once and stored for all heads until the
    orders or lines change."""
    def build():
        v = visits(spark, sf).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "acuity", "score").fillna(0)
        v = v.withColumn("hot", ((F.col("o_totalprice") > 300000) | (F.col("acuity") == 1)).cast("int")).drop("o_totalprice")
        lines = table(spark, sf, "lineitem", "l_orderkey", "l_quantity", "l_discount").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))
        # the split hangs on the orders alone, so it comes first; the visits then go through both joins with what the heads read
        parted = S.split_in_place(v, "hot", "o_orderkey")
        rows = _with_history(parted).join(lines, "o_orderkey", "left").fillna(0)
        return D.assemble_vector(rows, ["score", "qty", "disc", "n_prior"]).drop("score", "qty", "disc", "n_prior")
    return materialize(spark, f"{checkpoint_dir(spark)}/heads/features", [f"{sf}/orders.parquet", f"{sf}/lineitem.parquet"], "2", build)


@query("soft_cascade_head")
def soft_cascade_head(spark, sf):
    """Weighted multinomial head; its probabilities and its class become features."""
    rows = _features(spark, sf).withColumn("lab", F.col("acuity") - 1)
    train = rows.filter("split = 'train'")
    weighted = train.join(durable(class_weights(train, "lab", 0.5).select("lab", "weight")), "lab")
    model = D.fit_multiclass(weighted, "features", "lab", "weight", maxIter=5)
    out = D.soft_cascade(rows.filter("split = 'test'"), model, [f"p_level_{i}" for i in range(5)])
    out = D.hard_cascade(out, model, "level_pred")
    return rounded(out.select("o_orderkey", "level_pred", *[f"p_level_{i}" for i in range(5)]), *[f"p_level_{i}" for i in range(5)])


def _holdout(rows):
    """Training rows, a tenth of each label held out: cut off where the stored features lie, neither moved nor written again."""
    return S.split_in_place(rows.filter("split = 'train'").drop("split"), "hot", "o_orderkey", 0.1, 7)


def _calibrated(spark, sf):
    """Test rows with the boosted head's score p1 and its calibrated one, p_cal, fitted on a holdout."""
    rows = _features(spark, sf)
    parts = _holdout(rows)
    weighted = parts.filter("split = 'train'").withColumn("w", F.when(F.col("hot") == 1, 1.2).otherwise(1.0))
    model = D.fit_binary(weighted, "features", "hot", "w", maxIter=5, maxDepth=3, seed=42)
    score = lambda df: D.soft_cascade(df, model, ["p0", "p1"])
    iso = D.calibrate_isotonic(score(parts.filter("split = 'test'")), "p1", "hot")
    return D.apply_isotonic(score(rows.filter("split = 'test'")), iso, "p1", "p_cal")


# Isotonic value of point i: the largest over starts j <= i of the least mean over ends k >= i.
@query("isotonic_blocks", f"""
WITH p AS (SELECT floor(l_extendedprice / 100) AS x, CAST(count(*) AS DOUBLE) AS w, CAST(count(*) FILTER (WHERE l_quantity > 30) AS DOUBLE) AS s FROM lineitem GROUP BY 1),
c AS (SELECT x, w, s, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs FROM p),
m AS (SELECT b.x, a.x AS start, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.x ORDER BY b.x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least
  FROM c a JOIN c b ON a.x <= b.x),
v AS (SELECT x, max(least) AS value FROM m GROUP BY 1)
SELECT CAST(min(x) AS DOUBLE) AS lo, CAST(max(x) AS DOUBLE) AS hi, {R('value')} AS value, sum(w) AS weight FROM v JOIN p USING (x) GROUP BY v.value""")
def isotonic_blocks(spark, sf):
    """Blocks of the map from line price to the share of large quantities."""
    lines = table(spark, sf, "lineitem", "l_extendedprice", "l_quantity")
    rows = lines.select(F.floor(F.col("l_extendedprice") / 100).alias("price"), (F.col("l_quantity") > 30).cast("int").alias("large"))
    return rounded(fit_map(rows, "price", "large").blocks, "value")


@query("binary_head_gate")
def binary_head_gate(spark, sf):
    """Boosted head, isotonic calibration on a holdout, gate at the live threshold; metrics of the test part."""
    return rounded(D.gate(_calibrated(spark, sf), "p_cal").select("o_orderkey", "hot", "p_cal"), "p_cal")


@query("calibrated_classes")
def calibrated_classes(spark, sf, held="test"):
    """One-vs-rest isotonic maps on half of the vectors, applied to the other half, ``held``."""
    rows = S.stratified_split(_scores(spark, sf), "label", "vec_id", 0.5, 3)
    models = D.calibrate_ovr(rows.filter(F.col("split") != held), "p", "label", 10)
    out = D.apply_ovr(rows.filter(F.col("split") == held), models, "p", "cal")
    return M.topk_mrr(out, "label", "cal")


@query("importance_groups")
def importance_groups(spark, sf):
    rows = _features(spark, sf)
    cols = ["score", "qty", "disc", "n_prior"]
    model = D.fit_binary(rows.filter("split = 'train'"), "features", "hot", None, maxIter=5, maxDepth=3, seed=42)
    table_ = D.importance_table(spark, model, cols, {"score": "amounts", "qty": "lines", "disc": "lines", "n_prior": "history"})
    return rounded(D.importance_by_group(table_), "gain", "pct")


@query("text_feature_vectors", """
WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS t FROM part), g AS (SELECT p_partkey, unnest([t[1], t[2], t[1] || ' ' || t[2]]) AS term FROM w),
d AS (SELECT term, count(DISTINCT p_partkey) AS df, count(*) AS cf FROM g GROUP BY 1),
voc AS (SELECT term FROM d WHERE df >= 5 AND df <= 0.95 * (SELECT count(*) FROM part) ORDER BY cf DESC, term LIMIT 100)
SELECT p_partkey, CAST(100 AS INTEGER) AS dim, CAST(count(DISTINCT term) AS INTEGER) AS stored FROM g JOIN voc USING (term) GROUP BY 1""")
def text_feature_vectors(spark, sf):
    """Sparse MLlib vectors of part names: size and number of stored entries per part."""
    p = table(spark, sf, "part", "p_partkey", "p_name")
    grams, n = W.gram_arrays(p, "p_partkey", "p_name"), p.agg(F.count("*")).scalar()
    vocabulary = W.fit_vocabulary(grams, n, 5, 0.95, 100)
    weights = W.apply_tfidf(grams, W.fit_tfidf(vocabulary, n), "p_partkey")
    vec = D.text_vectors(weights, vocabulary, "p_partkey", 100).withColumn("a", vector_to_array("text_features"))
    return vec.select("p_partkey", F.size("a").alias("dim"), F.size(F.filter("a", lambda x: x != 0)).alias("stored"))
