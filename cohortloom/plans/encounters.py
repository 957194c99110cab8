"""Queries of the history and reading layers: strict-prior features, time windows, sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.text import bucket_rhythm, join_normalized, normalize_text
from ..operators import clean as C
from ..operators import history as H
from ..operators import joins as J
from ..operators import readings as G
from ..session import checkpoint_dir, durable
from .cohort import sql_normalize
from .registry import ORACLE, R, query, r6, rounded, table

# --- history -----------------------------------------------------------------------------------------

def _days(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 86400000000.0::DOUBLE)"


@query("prior_order_history", f"""
WITH h AS (SELECT a.o_orderkey, a.o_custkey, a.o_orderdate, a.o_totalprice, count(b.o_orderkey) AS n_prior, max(b.o_orderdate) AS last_at,
  arg_max(b.o_totalprice, (b.o_orderdate, b.o_orderkey)) AS last_value
  FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY ALL)
SELECT o_orderkey, n_prior, {R(f"CASE WHEN last_at IS NULL THEN 9999 ELSE least(greatest({_days('last_at', 'o_orderdate')}, 0), 9999) END")} AS days_since_last,
  last_value AS last_prior_value, CAST(CASE WHEN n_prior = 0 THEN 1 ELSE 0 END AS INTEGER) AS no_history FROM h""")
def prior_order_history(spark, sf):
    """For each order: how many earlier orders the customer has, days since the last one and its
    amount, and whether it is the first."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    entry = F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    out = H.prior_measures(o, o, "o_custkey", "o_orderdate", {
        "n_prior": ("sum", F.lit(1).cast("bigint")), "last": ("max", entry)})
    return out.select("o_orderkey", F.coalesce("n_prior", F.lit(0)).alias("n_prior"),
                      r6(H.recency(F.col("o_orderdate"), F.col("last.at"))).alias("days_since_last"),
                      F.col("last.value").alias("last_prior_value"), F.col("n_prior").isNull().cast("int").alias("no_history"))


@query("prior_flags", """
WITH f AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END AS big,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent FROM orders)
SELECT a.o_orderkey, CAST(coalesce(max(b.big), 0) AS INTEGER) AS pmh_big, CAST(coalesce(max(b.urgent), 0) AS INTEGER) AS pmh_urgent
FROM f a LEFT JOIN f b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY 1""")
def prior_flags(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    out = H.prior_measures(o, o, "o_custkey", "o_orderdate", {
        "pmh_big": ("max", (F.col("o_totalprice") > 450000).cast("int")),
        "pmh_urgent": ("max", (F.col("o_orderpriority") == "1-URGENT").cast("int"))})
    return out.select("o_orderkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pmh_big", "pmh_urgent")])


@query("last_prior_payload", """
SELECT a.o_orderkey, arg_max(b.o_totalprice, (b.o_orderdate, b.o_orderkey)) AS last_prior
FROM orders a LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate
GROUP BY 1""")
def last_prior_payload(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    out = H.last_prior_value(o, o, "o_custkey", "o_orderdate", "o_orderkey", F.col("o_totalprice"), F.col("o_orderstatus") == "F")
    return out.select("o_orderkey", "last_prior")


# Orders with status F act as admissions, all orders as visits; the visit text names the parts of all lines.
_TEXTS = """t AS (SELECT l_orderkey, string_agg(p_name, ', ' ORDER BY l_linenumber, p_name) || ', ' || max(p_type) AS complaint FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("intime"),
        "o_orderstatus", "o_totalprice", "o_orderpriority")


def _stays(spark, sf, orders=None):
    """Orders, all or the given ones, with the normalised text of their parts' names and kind."""
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_type").withColumnRenamed("p_partkey", "l_partkey")
    # names are normalised once per part, not in every order that holds them; where that changes nothing no second text is shuffled
    p = p.withColumns({f"{c}_norm": normalize_text(F.col(c)) for c in ("p_name", "p_type")}).withColumns(
        {f"{c}_norm": F.when(F.col(f"{c}_norm") != F.col(c), F.col(f"{c}_norm")) for c in ("p_name", "p_type")})
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    if orders is not None:
        lines = lines.join(orders.select(F.col("stay_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    lines = lines.join(p, "l_partkey")
    # lists are not worth collecting before the lines of an order are together: few meet in one task, and each would be sorted twice
    text = lines.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("stay_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name", "p_name_norm"))).alias("names"),
        F.max(F.struct("p_type", "p_type_norm")).alias("kind")).select("stay_id", join_normalized(F.concat(
            F.transform("names", lambda x: F.coalesce(x["p_name_norm"], x["p_name"])),
            F.array(F.coalesce("kind.p_type_norm", "kind.p_type")))).alias("complaint_text_norm"))
    return (_orders(spark, sf) if orders is None else orders).join(text, "stay_id", "left") \
        .withColumn("complaint_text_norm", F.coalesce("complaint_text_norm", F.lit("")))


@query("history_block", f"""
WITH {_TEXTS}, s AS (SELECT o_orderkey AS id, o_custkey AS subj, o_orderdate AS tm, o_orderstatus AS st, o_totalprice AS price,
  {sql_normalize('complaint')} AS txt FROM orders LEFT JOIN t ON l_orderkey = o_orderkey),
h AS (SELECT a.id, a.tm, a.txt, count(b.id) AS n_ed, count(CASE WHEN b.st = 'F' THEN 1 END) AS n_adm, max(b.tm) AS last_ed,
  max(CASE WHEN b.st = 'F' THEN b.tm END) AS last_adm, arg_max(b.txt, (b.tm, b.id)) AS prev_txt,
  max(CASE WHEN b.st = 'F' AND b.price > 450000 THEN 1 ELSE 0 END) AS pmh_big FROM s a LEFT JOIN s b ON a.subj = b.subj AND b.tm < a.tm GROUP BY ALL),
k AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(txt), '[a-z]+'), lambda w: length(w) > 2)) AS c,
  list_distinct(list_filter(regexp_extract_all(lower(coalesce(prev_txt, '')), '[a-z]+'), lambda w: length(w) > 2)) AS p FROM h)
SELECT id AS stay_id, CAST(pmh_big AS INTEGER) AS pmh_big, n_adm AS n_prior_admissions, n_ed AS n_prior_ed_visits,
  {R(f"CASE WHEN last_adm IS NULL THEN 9999 ELSE least({_days('last_adm', 'tm')}, 9999) END")} AS days_since_last_admission,
  {R(f"CASE WHEN last_ed IS NULL THEN 9999 ELSE least({_days('last_ed', 'tm')}, 9999) END")} AS days_since_last_ed,
  round_even(CASE WHEN len(c) > 0 AND len(p) > 0 THEN len(list_intersect(c, p))::DOUBLE / len(list_distinct(list_concat(c, p))) ELSE 0.0::DOUBLE END, 4) AS same_complaint_as_prior,
  CAST(CASE WHEN n_adm = 0 AND n_ed = 0 THEN 1 ELSE 0 END AS INTEGER) AS no_history FROM k""")
def history_block(spark, sf):
    s = _stays(spark, sf)
    adm = _orders(spark, sf).filter("o_orderstatus = 'F'").withColumn("pmh_big", (F.col("o_totalprice") > 450000).cast("int"))
    out = H.history_features(s, s, adm, ["pmh_big"])
    return rounded(out, "days_since_last_admission", "days_since_last_ed")


@query("anchor_now_history", f"""
WITH now AS (SELECT o_custkey, max(o_orderdate) AS at FROM orders GROUP BY 1)
SELECT n.o_custkey, count(o.o_orderkey) AS n_prior, {R(f"CASE WHEN max(o.o_orderdate) IS NULL THEN 9999 ELSE least({_days('max(o.o_orderdate)', 'any_value(n.at)')}, 9999) END")} AS days_since_last
FROM now n LEFT JOIN orders o ON n.o_custkey = o.o_custkey AND o.o_orderdate < n.at GROUP BY 1""")
def anchor_now_history(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderdate", "o_orderstatus")
    now = H.anchor_now(o.filter("o_orderstatus <> 'F'"), o.filter("o_orderstatus = 'F'"), "o_custkey", "o_orderdate")
    out = H.prior_encounters(now, o, "o_custkey", "o_orderdate")
    return out.select("o_custkey", F.coalesce("n_prior", F.lit(0)).alias("n_prior"),
                      r6(H.recency(F.col("o_orderdate"), F.col("last_prior"))).alias("days_since_last"))


@query("history_coverage", f"""
WITH h AS (SELECT a.o_orderkey, a.o_orderpriority, count(b.o_orderkey) AS n FROM orders a
  LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY ALL)
SELECT o_orderpriority, count(*) AS n, {R('avg(CASE WHEN n > 0 THEN 1 ELSE 0 END)')} AS has_prior, {R('avg(n)')} AS mean_prior FROM h GROUP BY 1""")
def history_coverage(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    out = H.prior_encounters(o, o, "o_custkey", "o_orderdate").withColumn("n_prior", F.coalesce("n_prior", F.lit(0)))
    return out.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r6(F.avg((F.col("n_prior") > 0).cast("int"))).alias("has_prior"),
                                              r6(F.avg("n_prior")).alias("mean_prior"))


@query("admission_flags", """
WITH g AS (SELECT l_orderkey AS hadm, p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type NOT IN ('MEDIUM')),
c AS (SELECT hadm, CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS promo, CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END AS small FROM g
  UNION ALL SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END, 0 FROM orders)
SELECT hadm AS hadm_id, CAST(max(promo) AS INTEGER) AS pmh_promo, CAST(max(small) AS INTEGER) AS pmh_small FROM c GROUP BY 1""")
def admission_flags(spark, sf):
    icd = table(spark, sf, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("hadm_id"), F.col("l_partkey").alias("icd_code"))
    groups = table(spark, sf, "part", "p_partkey", "p_type").select(F.col("p_partkey").alias("icd_code"), F.col("p_type").alias("group"))
    notes = table(spark, sf, "orders", "o_orderkey", "o_orderpriority").select(
        F.col("o_orderkey").alias("hadm_id"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("pmh_promo"), F.lit(0).alias("pmh_small"))
    return H.flags_by_admission(icd, groups, notes, {"PROMO": "pmh_promo", "SMALL": "pmh_small"}, drop_group="MEDIUM")


@query("history_index", """
WITH s AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM s))
SELECT 'ed_visits' AS name, count(*) AS n FROM o UNION ALL SELECT 'admissions', count(*) FROM o WHERE o_orderstatus = 'F' UNION ALL
SELECT 'icd_flags', count(*) FROM o WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' UNION ALL
SELECT 'note_flags', count(*) FROM o WHERE o_orderstatus = 'F' AND o_totalprice > 450000 UNION ALL
SELECT 'med_blocks', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def history_index(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("stay_id"),
                                          F.col("o_orderkey").alias("hadm_id"), "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice")
    subjects = table(spark, sf, "customer", "c_custkey", "c_mktsegment").filter("c_mktsegment = 'BUILDING'") \
        .select(F.col("c_custkey").alias("subject_id"))
    meds = table(spark, sf, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("stay_id")).agg(F.count("*").alias("n_medications"))
    index = H.build_history_index(o, o.filter("o_orderstatus = 'F'"), o.filter("o_orderpriority = '1-URGENT'").select("hadm_id"),
                                  o.filter("o_totalprice > 450000").select("hadm_id"), meds, subjects)
    out = None
    for name, df in index.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("history_lookup", f"SELECT * FROM ({ORACLE['history_block']}) WHERE stay_id IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')")
def history_lookup(spark, sf):
    """The history index of a list of subjects is stored and loaded; their visits are looked up in it alone."""
    subjects = table(spark, sf, "customer", "c_custkey", "c_mktsegment").filter("c_mktsegment = 'BUILDING'") \
        .select(F.col("c_custkey").alias("subject_id"))
    o = _orders(spark, sf)
    # range bounds are sampled from what is stored, so the texts are made once and not for the sample again
    s = durable(_stays(spark, sf, o.join(subjects, "subject_id", "left_semi")).withColumn("hadm_id", F.col("stay_id")))
    admitted = o.filter("o_orderstatus = 'F'").withColumn("hadm_id", F.col("stay_id"))
    adm = admitted.select("subject_id", "hadm_id", "intime")
    flags = admitted.select("hadm_id", (F.col("o_totalprice") > 450000).cast("int").alias("pmh_big"))
    meds = table(spark, sf, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("stay_id")).agg(F.count("*").alias("n_medications"))
    path = f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    H.save_history_index(H.build_history_index(s, adm, flags.limit(0), flags, meds, subjects), path, {
        "ed_visits": ["subject_id", "intime"], "admissions": ["subject_id", "intime"], "icd_flags": ["hadm_id"],
        "note_flags": ["hadm_id"], "med_blocks": ["stay_id"]})
    index = H.load_history_index(spark, path, ["ed_visits", "admissions", "note_flags"])
    known = index["admissions"].join(index["note_flags"], "hadm_id", "left")
    out = H.history_features(index["ed_visits"], index["ed_visits"], known, ["pmh_big"])
    return rounded(out, "days_since_last_admission", "days_since_last_ed")


# --- readings ----------------------------------------------------------------------------------------

# One anchor per user: the first signup; the window is 72 hours.
_HOURS = 72
_ANCHOR = "a AS (SELECT user_id, min(ts) AS intime FROM events WHERE event_type = 'signup' GROUP BY 1)"
_WINDOW = f"""{_ANCHOR},
w AS (SELECT e.*, a.intime FROM events e JOIN a ON e.user_id = a.user_id AND e.ts >= a.intime AND e.ts <= a.intime + INTERVAL {_HOURS} HOUR)"""


def _anchors(spark, sf):
    return table(spark, sf, "events", "user_id", "ts", "event_type").filter("event_type = 'signup'") \
        .groupBy("user_id").agg(F.min("ts").alias("intime"))


def _window(spark, sf, *cols):
    events = table(spark, sf, "events", "event_id", "user_id", "ts", "event_type", "value", *cols)
    return J.within_window(events, _anchors(spark, sf), "user_id", "ts", "intime", _HOURS)


@query("window_readings", f"""
WITH {_WINDOW} SELECT event_id, user_id, {R('(epoch_us(ts) - epoch_us(intime)) / 3600000000.0::DOUBLE')} AS hours_in FROM w""")
def window_readings(spark, sf):
    return _window(spark, sf).select("event_id", "user_id", r6(P.hours_between(F.col("intime"), F.col("ts"))).alias("hours_in"))


@query("series_stats", f"""
WITH {_WINDOW} SELECT user_id, min(v) AS value_min, max(v) AS value_max, arg_max(v, (ts, event_id)) AS value_last,
  {R('arg_max(v, (ts, event_id)) - arg_min(v, (ts, event_id))')} AS value_delta
FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v FROM w) GROUP BY 1""")
def series_stats(spark, sf):
    w = _window(spark, sf).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return rounded(G.series_stats(w, ["user_id"], ["ts", "event_id"], ["value"]), "value_delta")


@query("abnormal_counts", f"""
WITH {_WINDOW} SELECT user_id, count(CASE WHEN value > 100 THEN 1 END) AS n_high, count(CASE WHEN value < 20 THEN 1 END) AS n_low,
  CAST(CASE WHEN bool_or(event_type = 'error') THEN 1 ELSE 0 END AS INTEGER) AS any_error FROM w GROUP BY 1""")
def abnormal_counts(spark, sf):
    w = _window(spark, sf)
    counts = G.count_where(w, ["user_id"], {"n_high": F.col("value") > 100, "n_low": F.col("value") < 20})
    return counts.join(G.any_where(w, ["user_id"], F.col("event_type") == "error", "any_error"), "user_id")


@query("modal_event", """
SELECT user_id, event_type AS modal FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min((ts, event_id))) AS rn
  FROM events GROUP BY 1, 2) WHERE rn = 1""")
def modal_event(spark, sf):
    return G.modal_bucket(table(spark, sf, "events", "event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query("reading_sequence", """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS reading_no, value FROM events""")
def reading_sequence(spark, sf):
    seq = G.reading_sequence(table(spark, sf, "events", "event_id", "user_id", "ts", "value"), ["user_id"], "ts", "event_id", "value")
    return seq.select("user_id", "event_id", "reading_no", "value")


@query("reading_arrays", """
WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT user_id, CAST((rn - 1) // 25 AS BIGINT) AS part_no, array_to_string(list(CAST(round(value * 100) AS BIGINT) ORDER BY rn), ',') AS cents FROM s GROUP BY 1, 2""")
def reading_arrays(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id", "ts", "value")
    seq = G.reading_sequence(e, ["user_id"], "ts", "event_id", "value")
    out = G.reading_arrays(seq, ["user_id"], "value", 25)
    return out.select("user_id", "part_no", F.array_join(F.transform("value", lambda v: F.round(v * 100).cast("bigint").cast("string")), ",").alias("cents"))


_RHYTHM_SQL = """CASE event_type WHEN 'click' THEN 'sinus' WHEN 'view' THEN 'sinus_tachy' WHEN 'purchase' THEN
  CASE WHEN value < 10 THEN 'afib_flutter' WHEN value < 20 THEN 'paced' WHEN value < 30 THEN 'av_block' WHEN value < 40 THEN 'svt' ELSE 'sinus_brady' END
  WHEN 'error' THEN '' ELSE CASE WHEN value < 50 THEN 'other' ELSE 'sinus' END END"""


def _rhythm_text():
    e, v = F.col("event_type"), F.col("value")
    return (F.when(e == "click", " NSR ").when(e == "view", "Sinus Tachycardia")
            .when((e == "purchase") & (v < 10), "Atrial Fibrillation").when((e == "purchase") & (v < 20), "V-paced")
            .when((e == "purchase") & (v < 30), "1° AV").when((e == "purchase") & (v < 40), "SVT")
            .when(e == "purchase", "sinus brady").when((e == "signup") & (v < 50), "junctional")
            .when(e == "signup", "Sinus Arrythmia"))


@query("rhythm_buckets", f"SELECT {_RHYTHM_SQL} AS bucket, count(*) AS n FROM events GROUP BY 1")
def rhythm_buckets(spark, sf):
    return table(spark, sf, "events", "event_type", "value").select(bucket_rhythm(_rhythm_text()).alias("bucket")) \
        .groupBy("bucket").agg(F.count("*").alias("n"))


@query("longitudinal_block", f"""
WITH {_WINDOW}, c AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'error' THEN least(greatest(value, 20.0::DOUBLE), 250.0::DOUBLE) END AS v, {_RHYTHM_SQL} AS b FROM w),
m AS (SELECT user_id, b, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min((ts, event_id))) AS rn FROM c WHERE b <> '' GROUP BY 1, 2)
SELECT c.user_id, min(v) AS heartrate_min, max(v) AS heartrate_max, arg_max(v, (ts, event_id)) AS heartrate_last,
  {R('arg_max(v, (ts, event_id)) - arg_min(v, (ts, event_id))')} AS heartrate_delta,
  count(CASE WHEN v > 100 THEN 1 END) AS n_tachycardia_readings, count(CASE WHEN v < 60 THEN 1 END) AS n_bradycardia_readings,
  CAST(CASE WHEN bool_or(c.b NOT IN ('', 'sinus')) THEN 1 ELSE 0 END AS INTEGER) AS rhythm_irregular,
  CAST(coalesce(max(CASE WHEN m.b = 'sinus' THEN 1 ELSE 0 END), 0) AS INTEGER) AS rhythm_sinus,
  CAST(coalesce(max(CASE WHEN m.b = 'sinus_tachy' THEN 1 ELSE 0 END), 0) AS INTEGER) AS rhythm_sinus_tachy, CAST(1 AS INTEGER) AS has_longitudinal_vitals
FROM c LEFT JOIN (SELECT * FROM m WHERE rn = 1) m ON c.user_id = m.user_id GROUP BY 1""")
def longitudinal_block(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id", "ts", "event_type", "value") \
        .withColumn("rhythm", _rhythm_text()).withColumn("heartrate", F.when(F.col("event_type") != "error", F.col("value")))
    ab = {k: v for k, v in P.ABNORMAL.items() if v[0] == "heartrate"}
    out = G.longitudinal_features(e, _anchors(spark, sf), "user_id", "ts", "intime", _HOURS, "rhythm", ["heartrate"], ab, "event_id")
    keep = ["user_id", "heartrate_min", "heartrate_max", "heartrate_last", "heartrate_delta", "n_tachycardia_readings",
            "n_bradycardia_readings", "rhythm_irregular", "rhythm_sinus", "rhythm_sinus_tachy", "has_longitudinal_vitals"]
    return rounded(out.select(*keep), "heartrate_delta")


@query("fill_longitudinal", f"""
WITH {_WINDOW}, s AS (SELECT user_id, avg(value) AS value FROM events GROUP BY 1),
g AS (SELECT user_id, min(value) AS lo, max(value) AS hi, arg_max(value, (ts, event_id)) AS last, arg_min(value, (ts, event_id)) AS first,
  count(CASE WHEN value > 100 THEN 1 END) AS n_high FROM w GROUP BY 1)
SELECT s.user_id, {R('coalesce(lo, value)')} AS value_min, {R('coalesce(hi, value)')} AS value_max, {R('coalesce(last, value)')} AS value_last,
  {R('coalesce(last - first, 0)')} AS value_delta, coalesce(n_high, CASE WHEN value > 50 THEN 1 ELSE 0 END) AS n_high,
  CAST(CASE WHEN lo IS NULL THEN 0 ELSE 1 END AS INTEGER) AS has_longitudinal_vitals FROM s LEFT JOIN g ON s.user_id = g.user_id""")
def fill_longitudinal(spark, sf):
    w = _window(spark, sf)
    block = G.series_stats(w, ["user_id"], ["ts", "event_id"], ["value"]) \
        .join(G.count_where(w, ["user_id"], {"n_high": F.col("value") > 100}), "user_id").withColumn("has_longitudinal_vitals", F.lit(1))
    snap = table(spark, sf, "events", "user_id", "value").groupBy("user_id").agg(F.avg("value").alias("value")) \
        .withColumn("high", (F.col("value") > 50).cast("int"))
    out = C.fill_longitudinal(J.left_child(snap, block, "user_id"), ["value"], {"n_high": "high"})
    return rounded(out.drop("value", "high"), "value_min", "value_max", "value_last", "value_delta")


@query("props_json", f"""
SELECT event_type, count(*) AS n, sum(k)::BIGINT AS total, max(k) AS top FROM (
  SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1""")
def props_json(spark, sf):
    e = table(spark, sf, "events", "event_type", "props").withColumn("b", P.parse_block(F.col("props"), "k int"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("b.k").alias("total"), F.max("b.k").alias("top"))


@query("trajectory_blob", f"""
WITH b AS (SELECT event_id, value, event_type FROM events)
SELECT event_type, sum(CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'click' THEN 1 ELSE 2 END)::BIGINT AS n_readings,
  {R("sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END)", 4)} AS first_total,
  sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS n_rhythm FROM b GROUP BY 1""")
def trajectory_blob(spark, sf):
    v = F.col("value").cast("string")
    blob = (F.when(F.col("event_type") == "error", "none")
            .when(F.col("event_type") == "click", F.format_string('{"heartrate": %s}', v))
            .when(F.col("event_type") == "view", F.format_string('{"heartrate": [%s, null, "98.6"], "rhythm": ["sinus", " ", "NA"]}', v))
            .otherwise(F.format_string('{"heartrate": [%s, "x", 60], "rhythm": "n/a"}', v)))
    t = table(spark, sf, "events", "event_type", "value").select("event_type", P.parse_trajectory(blob).alias("t"))
    n = lambda c: F.sum(F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))).cast("bigint")
    return t.groupBy("event_type").agg(n("t.heartrate").alias("n_readings"),
                                       r6(F.sum(F.coalesce(F.get(F.col("t.heartrate"), F.lit(0)), F.lit(0.0))), 4).alias("first_total"),
                                       n("t.rhythm").alias("n_rhythm"))


@query("time_parts", f"""
SELECT event_type, CAST(year(ts) AS INTEGER) AS yr, count(*) AS n, {R("sum((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0::DOUBLE)", 3)} AS hours,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS bad_times FROM events GROUP BY 1, 2""")
def time_parts(spark, sf):
    e = table(spark, sf, "events", "event_type", "ts")
    raw = F.when(F.col("event_type") == "error", "not a time").otherwise(F.col("ts").cast("string"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return e.groupBy("event_type", F.year("ts").alias("yr")).agg(
        F.count("*").alias("n"), r6(F.sum(P.hours_between(start, F.col("ts"))), 3).alias("hours"),
        F.sum(P.parse_ts(raw).isNull().cast("int")).alias("bad_times"))


# Three reading rounds per event; every third user's last round lacks a time, so entry order stays.
@query("round_order", """
WITH d AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT CASE WHEN user_id % 3 = 0 THEN '0,1,2' ELSE array_to_string(list_transform(list_sort(
  [{'t': k, 'i': 0}, {'t': (k * 7) % 50, 'i': 1}, {'t': (k * 13) % 50, 'i': 2}]), lambda x: x.i), ',') END AS ordered, count(*) AS n FROM d GROUP BY 1""")
def round_order(spark, sf):
    k = P.parse_block(F.col("props"), "k int").getField("k")
    e = table(spark, sf, "events", "user_id", "props").withColumn("k", k)
    entry = lambda t, i: F.struct(t.cast("double").alias("ts"), F.lit(str(i)).alias("no"))
    late = F.when(F.col("user_id") % 3 != 0, (F.col("k") * 13) % 50)
    rounds = F.array(entry(F.col("k"), 0), entry((F.col("k") * 7) % 50, 1), entry(late, 2))
    return e.select(F.array_join(F.transform(P.order_rounds(rounds), lambda x: x["no"]), ",").alias("ordered")) \
        .groupBy("ordered").agg(F.count("*").alias("n"))


@query("array_block", f"""
SELECT event_type, {R('sum(lo)')} AS lo, {R('sum(hi)')} AS hi, {R('sum(last)')} AS last, {R('sum(delta)')} AS delta, sum(n_high)::BIGINT AS n_high FROM (
  SELECT event_type, CASE WHEN event_type = 'error' THEN 84 ELSE least(v, 100) END AS lo, CASE WHEN event_type = 'error' THEN 84 ELSE greatest(v, 100) END AS hi,
    CASE WHEN event_type = 'error' THEN 84 ELSE 100 END AS last, CASE WHEN event_type = 'error' THEN 0 ELSE 100 - v END AS delta,
    CASE WHEN event_type = 'error' THEN 1 ELSE (CASE WHEN v > 90 THEN 1 ELSE 0 END) + 1 END AS n_high
  FROM (SELECT event_type, least(greatest(value, 20), 250)::DOUBLE AS v FROM events)) GROUP BY 1""")
def array_block(spark, sf):
    arr = F.when(F.col("event_type") != "error", P.clip_array(F.array(F.col("value"), F.lit(100.0)), 20, 250))
    s = P.array_series_stats(arr, F.lit(84.0))
    e = table(spark, sf, "events", "event_type", "value").select(
        "event_type", s["min"].alias("lo"), s["max"].alias("hi"), s["last"].alias("last"), s["delta"].alias("delta"),
        P.array_count(arr, ">", 90, F.lit(1)).alias("n_high"))
    return e.groupBy("event_type").agg(*[r6(F.sum(c)).alias(c) for c in ("lo", "hi", "last", "delta")], F.sum("n_high").alias("n_high"))
