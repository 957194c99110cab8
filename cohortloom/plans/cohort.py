"""Queries of the cohort layer: scans, joins, cleaning rules, per-key aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.parsing import parse_block
from ..functions.text import ABBREVIATIONS, normalize_text
from ..operators import aggregates as A
from ..operators import clean as C
from ..operators import joins as J
from ..session import durable
from ..sources import read_codes, scan_for_keys
from .registry import R, VISITS, query, r6, rounded, table, visits

# --- scans and joins ---------------------------------------------------------------------------------


@query("cohort_join", f"""
SELECT c_mktsegment, o_orderstatus, count(*) AS n_lines, {R('sum(l_quantity)')} AS qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
GROUP BY 1, 2""")
def cohort_join(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_quantity").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    customers = table(spark, sf, "customer", "c_custkey", "c_mktsegment").withColumnRenamed("c_custkey", "o_custkey")
    joined = J.left_lookup(J.join_on(lines, orders, ["o_orderkey"]), customers, "o_custkey")
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(
        F.count("*").alias("n_lines"), r6(F.sum("l_quantity")).alias("qty"))


@query("semi_scan", f"""
SELECT l_returnflag, count(*) AS n, {R('sum(l_extendedprice)', 2)} AS total FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def semi_scan(spark, sf):
    keys = table(spark, sf, "orders", "o_orderkey", "o_orderstatus").filter("o_orderstatus = 'F'") \
        .withColumnRenamed("o_orderkey", "l_orderkey")
    big = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_extendedprice")
    return scan_for_keys(big, keys, "l_orderkey").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), r6(F.sum("l_extendedprice"), 2).alias("total"))


@query("keys_in_both", """
SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'
  AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def keys_in_both(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    return J.keys_in_both(o.filter("o_orderstatus = 'F'"), o.filter("o_orderpriority = '1-URGENT'"), ["o_custkey"])


@query("narrow_and_child", f"""
WITH first_line AS (SELECT l_orderkey, min(l_partkey) AS partkey FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
kids AS (SELECT l_orderkey, count(*) AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderstatus, count(*) AS n, sum(coalesce(n_lines, 0))::BIGINT AS returned, sum(partkey)::BIGINT AS parts
FROM orders o JOIN first_line f ON o.o_orderkey = f.l_orderkey LEFT JOIN kids k ON o.o_orderkey = k.l_orderkey GROUP BY 1""")
def narrow_and_child(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag") \
        .withColumnRenamed("l_orderkey", "o_orderkey")
    first = C.primary_only(lines, "l_linenumber").groupBy("o_orderkey").agg(F.min("l_partkey").alias("partkey"))
    kids = A.count_by(C.filter_eq(lines, "l_returnflag", "R"), ["o_orderkey"], "n_lines")
    orders = table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    out = J.left_child(J.narrow_by(orders, first, "o_orderkey"), kids, "o_orderkey")
    return out.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("n_lines", F.lit(0))).alias("returned"), F.sum("partkey").alias("parts"))


@query("one_per_key", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
WHERE rn = 1""")
def one_per_key(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return J.one_per_key(lines, ["l_orderkey"], [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")])


@query("code_read", """
SELECT upper(trim(coalesce(p_brand, ''))) AS p_brand, trim(coalesce(CAST(p_size AS VARCHAR), '')) AS p_size, count(*) AS n
FROM part GROUP BY 1, 2""")
def code_read(spark, sf):
    return read_codes(table(spark, sf, "part", "p_brand", "p_size"), "p_brand", "p_size") \
        .groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))


# --- filters, labels, levels ---------------------------------------------------------------------------


@query("require_text", """
SELECT lang, source, count(*) AS n FROM documents WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY 1, 2""")
def require_text(spark, sf):
    return C.require_text(table(spark, sf, "documents", "text", "lang", "source"), "text") \
        .groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("filter_and_label", """
SELECT o_orderpriority, label, count(*) AS n FROM (
  SELECT o_orderpriority, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS label FROM orders WHERE o_orderstatus = 'F')
GROUP BY 1, 2""")
def filter_and_label(spark, sf):
    o = table(spark, sf, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice") \
        .withColumn("level", F.when(F.col("o_totalprice") > 250000, "HIGH").otherwise("LOW"))
    return C.binary_label(C.filter_eq(o, "o_orderstatus", "F"), "level", "HIGH") \
        .groupBy("o_orderpriority", "label").agg(F.count("*").alias("n"))


@query("valid_acuity", """
SELECT acuity, count(*) AS n FROM (
  SELECT try_cast(CASE WHEN o_orderpriority LIKE '3%' THEN 'x' ELSE substr(o_orderpriority, 1, 1) END AS INTEGER) AS acuity
  FROM orders) WHERE acuity BETWEEN 1 AND 4 GROUP BY 1""")
def valid_acuity(spark, sf):
    raw = F.when(F.col("o_orderpriority").startswith("3"), "x").otherwise(F.substring("o_orderpriority", 1, 1))
    o = table(spark, sf, "orders", "o_orderpriority").select(raw.alias("acuity"))
    return C.valid_int(o, "acuity", 1, 4).groupBy("acuity").agg(F.count("*").alias("n"))


@query("primary_line", f"""
SELECT l_returnflag, count(*) AS n, {R('sum(l_extendedprice)', 2)} AS total FROM lineitem WHERE l_linenumber = 1 GROUP BY 1""")
def primary_line(spark, sf):
    lines = table(spark, sf, "lineitem", "l_linenumber", "l_returnflag", "l_extendedprice")
    return C.primary_only(lines, "l_linenumber").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), r6(F.sum("l_extendedprice"), 2).alias("total"))


_TYPES = {"ECONOMY": "basic", "STANDARD": "basic", "PROMO": "promo", "LARGE": "sized", "SMALL": "sized"}


@query("map_with_default", f"""
SELECT CASE p_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items())} ELSE 'Other' END AS grp,
  count(*) AS n, {R('avg(p_retailprice)')} AS avg_price FROM part GROUP BY 1""")
def map_with_default(spark, sf):
    p = C.map_with_default(table(spark, sf, "part", "p_type", "p_retailprice"), "p_type", _TYPES, "Other", "grp")
    return p.groupBy("grp").agg(F.count("*").alias("n"), r6(F.avg("p_retailprice")).alias("avg_price"))


@query("exclude_catch_all", "SELECT p_type, count(*) AS n FROM part WHERE p_type IS DISTINCT FROM 'MEDIUM' GROUP BY 1")
def exclude_catch_all(spark, sf):
    kept, _ = C.exclude_with_audit(table(spark, sf, "part", "p_type"), "p_type", "MEDIUM")
    return kept.groupBy("p_type").agg(F.count("*").alias("n"))


@query("exclusion_counts", """SELECT CAST('MEDIUM' AS VARCHAR) AS level, count(*) AS n_before, count(CASE WHEN p_type IS DISTINCT FROM 'MEDIUM' THEN 1 END) AS n_after FROM part""")
def exclusion_counts(spark, sf):
    """Rows before and after the exclusion, as observed while the kept rows are written."""
    kept, seen = C.exclude_with_audit(table(spark, sf, "part", "p_type"), "p_type", "MEDIUM")
    kept.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([("MEDIUM", seen.get["before"], seen.get["after"])], "level string, n_before bigint, n_after bigint")


@query("one_hot_priority", """
SELECT o_orderstatus, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS urgent,
  sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END)::BIGINT AS high,
  sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END)::BIGINT AS low FROM orders GROUP BY 1""")
def one_hot_priority(spark, sf):
    levels = {"urgent": "1-URGENT", "high": "2-HIGH", "low": "5-LOW"}
    o = C.one_hot_fixed(table(spark, sf, "orders", "o_orderstatus", "o_orderpriority"), "o_orderpriority", levels)
    return o.groupBy("o_orderstatus").agg(*[F.sum(c).alias(c) for c in levels])


@query("normalize_field", """
SELECT CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN upper(o_orderpriority) = '1-URGENT' THEN 'ambulance'
  WHEN upper(o_orderpriority) = '2-HIGH' THEN 'helicopter' WHEN upper(o_orderpriority) = '5-LOW' THEN 'walk_in'
  ELSE 'other' END AS arrival, count(*) AS n FROM orders GROUP BY 1""")
def normalize_field(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "P", " Unknown ").otherwise(F.concat(F.lower("o_orderpriority"), F.lit(" ")))
    o = table(spark, sf, "orders", "o_orderstatus", "o_orderpriority").select(C.normalize_field(
        raw, {"1-URGENT": "ambulance", "2-HIGH": "helicopter", "5-LOW": "walk_in"}, "other").alias("arrival"))
    return o.groupBy("arrival").agg(F.count("*").alias("n"))


@query("label_index", """
SELECT CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS label_idx, p_type, n
FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)""")
def label_index(spark, sf):
    return C.label_index(table(spark, sf, "part", "p_type"), "p_type").groupBy("label_idx", "p_type") \
        .agg(F.count("*").alias("n"))


# --- numbers -----------------------------------------------------------------------------------------


@query("clean_score", """
WITH s AS (SELECT CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL ELSE l_quantity * 0.31 - 2 END AS raw FROM lineitem)
SELECT CASE WHEN trunc(coalesce(raw, -1)) BETWEEN 0 AND 10 THEN CAST(trunc(coalesce(raw, -1)) AS INTEGER) ELSE -1 END AS pain,
  CASE WHEN raw IS NULL THEN 1 ELSE 0 END AS pain_missing, count(*) AS n FROM s GROUP BY 1, 2""")
def clean_score(spark, sf):
    lines = table(spark, sf, "lineitem", "l_quantity", "l_returnflag", "l_linestatus")
    bad = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")
    raw = F.when(bad, "severe").otherwise((F.col("l_quantity") * 0.31 - 2).cast("string"))
    return C.clean_bounded_score(lines.select(raw.alias("pain")), "pain").groupBy("pain", "pain_missing") \
        .agg(F.count("*").alias("n"))


_EDGES = [0, 18, 35, 50, 65, 80, 120]


@query("age_bins", f"""
WITH a AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 50 ELSE CAST(least(greatest(o_custkey % 130 - 5
    + (year(o_orderdate) - 1996), 0), 120) AS INTEGER) END AS age FROM orders)
SELECT {'CASE ' + ' '.join(f'WHEN age > {lo} AND age <= {hi} THEN {i}' for i, (lo, hi) in enumerate(zip(_EDGES[:-1], _EDGES[1:]))) + ' ELSE 2 END'} AS age_bin,
  min(age) AS min_age, max(age) AS max_age, count(*) AS n FROM a GROUP BY 1""")
def age_bins(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderdate", "o_orderstatus").withColumns({
        "anchor_age": F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 130 - 5), "anchor_year": F.lit(1996)})
    aged = C.age_at(o, "o_orderdate", "anchor_age", "anchor_year")
    return C.right_closed_bins(aged, "age", _EDGES, 2, "age_bin").groupBy("age_bin").agg(
        F.min("age").alias("min_age"), F.max("age").alias("max_age"), F.count("*").alias("n"))


def _readings(spark, sf):
    """Event values as raw text readings; two kinds are unusable."""
    raw = F.when(F.col("event_type") == "error", "n/a").when(F.col("value") < 1, None).otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events", "event_type", "value").withColumn("value", raw)


_RAW = """e AS (SELECT event_type, CASE WHEN event_type = 'error' OR value < 1 THEN NULL ELSE value END AS value FROM events)"""


@query("numeric_clean", f"""
WITH {_RAW} SELECT event_type, count(*) AS n, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing,
  {R('sum(value)')} AS total FROM e GROUP BY 1""")
def numeric_clean(spark, sf):
    return C.coerce_numeric(_readings(spark, sf), ["value"]).groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("value_missing").alias("n_missing"), r6(F.sum("value")).alias("total"))


@query("clip_values", f"""
WITH {_RAW} SELECT event_type, count(v) AS n, {R('sum(v)')} AS total, min(v) AS lo, max(v) AS hi FROM (
  SELECT event_type, CASE WHEN value IS NOT NULL THEN least(greatest(value, 20.0::DOUBLE), 150.0::DOUBLE) END AS v FROM e) GROUP BY 1""")
def clip_values(spark, sf):
    df = C.clip_range(C.coerce_numeric(_readings(spark, sf), ["value"]), {"value": (20, 150)})
    return df.groupBy("event_type").agg(F.count("value").alias("n"), r6(F.sum("value")).alias("total"),
                                        F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("null_out_values", f"""
WITH {_RAW} SELECT event_type, count(v) AS n, {R('sum(v)')} AS total, min(v) AS lo, max(v) AS hi FROM (
  SELECT event_type, CASE WHEN value BETWEEN 20 AND 150 THEN value END AS v FROM e) GROUP BY 1""")
def null_out_values(spark, sf):
    df = C.null_out_of_range(C.coerce_numeric(_readings(spark, sf), ["value"]), {"value": (20, 150)})
    return df.groupBy("event_type").agg(F.count("value").alias("n"), r6(F.sum("value")).alias("total"),
                                        F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("fill_and_flag", f"""
WITH {_RAW}, f AS (SELECT event_type, CASE WHEN value IS NULL THEN 84.0::DOUBLE ELSE least(greatest(value, 20.0::DOUBLE), 150.0::DOUBLE) END AS v FROM e)
SELECT event_type, sum(CASE WHEN v > 100 THEN 1 ELSE 0 END)::BIGINT AS tachycardia,
  sum(CASE WHEN v < 60 THEN 1 ELSE 0 END)::BIGINT AS bradycardia, {R('avg(v)')} AS mean_value FROM f GROUP BY 1""")
def fill_and_flag(spark, sf):
    df = C.clip_range(C.coerce_numeric(_readings(spark, sf), ["value"]), {"value": (20, 150)})
    df = C.threshold_flags(C.fill_constants(df, {"value": 84}), {"tachycardia": ("value", ">", 100), "bradycardia": ("value", "<", 60)})
    return df.groupBy("event_type").agg(F.sum("tachycardia").alias("tachycardia"), F.sum("bradycardia").alias("bradycardia"),
                                        r6(F.avg("value")).alias("mean_value"))


@query("median_impute", f"""
WITH {_RAW}, c AS (SELECT event_type, CASE WHEN value BETWEEN 20 AND 150 THEN value END AS v FROM e),
m AS (SELECT median(v) AS med FROM c WHERE event_type <> 'click')
SELECT event_type, count(*) AS n, {R('avg(coalesce(v, med))')} AS mean_value, {R('min(med)')} AS fitted FROM c, m GROUP BY 1""")
def median_impute(spark, sf):
    df = C.null_out_of_range(C.coerce_numeric(_readings(spark, sf), ["value"]), {"value": (20, 150)})
    med = durable(C.fit_median(df.filter("event_type <> 'click'"), ["value"]))
    return C.apply_median(df, med, ["value"]).withColumn("fitted", med.select(F.max("median")).scalar()) \
        .groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"), r6(F.min("fitted")).alias("fitted"))


_FLAG_SPEC = {"fever": ("value", ">", 100.4), "hypothermic": ("value", "<", 20), "tachycardic": ("value", ">", 60),
              "bradycardic": ("value", "<", 40), "tachypneic": ("value", ">", 30), "hypoxic": ("value", "<", 10),
              "hypertensive": ("value", ">", 140), "hypotensive": ("value", "<", 30)}


@query("abnormal_flag_count", f"""
SELECT event_type, CAST({' + '.join(f'(CASE WHEN value {op} {lim} THEN 1 ELSE 0 END)' for _, op, lim in _FLAG_SPEC.values())} AS INTEGER)
  AS abnormal_vital_count, count(*) AS n FROM events GROUP BY 1, 2""")
def abnormal_flag_count(spark, sf):
    df = C.threshold_flags(table(spark, sf, "events", "event_type", "value"), _FLAG_SPEC)
    return C.flag_count(df, list(_FLAG_SPEC)).groupBy("event_type", "abnormal_vital_count").agg(F.count("*").alias("n"))


@query("mean_pressure", f"""
SELECT l_returnflag, {R('sum((l_quantity + 2 * l_tax) / 3)')} AS total_map, {R('max((l_quantity + 2 * l_tax) / 3)')} AS max_map
FROM lineitem GROUP BY 1""")
def mean_pressure(spark, sf):
    df = C.mean_arterial(table(spark, sf, "lineitem", "l_returnflag", "l_quantity", "l_tax"), "l_quantity", "l_tax")
    return df.groupBy("l_returnflag").agg(r6(F.sum("map")).alias("total_map"), r6(F.max("map")).alias("max_map"))


@query("mask_unless", f"""
SELECT o_orderpriority, count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice END) AS n_known,
  {R("sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice END)", 2)} AS total FROM orders GROUP BY 1""")
def mask_unless(spark, sf):
    df = C.mask_unless(table(spark, sf, "orders", "o_orderpriority", "o_totalprice"), ["o_totalprice"],
                       F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return df.groupBy("o_orderpriority").agg(F.count("o_totalprice").alias("n_known"), r6(F.sum("o_totalprice"), 2).alias("total"))


@query("mask_features", f"""
SELECT o_orderpriority, {R("sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 250000 END)", 2)} AS total,
  sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END)::BIGINT AS missing,
  sum(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 1 ELSE 0 END)::BIGINT AS high FROM orders GROUP BY 1""")
def mask_features(spark, sf):
    df = table(spark, sf, "orders", "o_orderpriority", "o_totalprice").withColumns({
        "o_totalprice_missing": F.col("o_totalprice").isNull().cast("int"), "high": (F.col("o_totalprice") > 300000).cast("int")})
    df = C.mask_features(df, F.col("o_orderpriority") == "1-URGENT", {"o_totalprice": 250000}, ["high"])
    return df.groupBy("o_orderpriority").agg(r6(F.sum("o_totalprice"), 2).alias("total"),
                                             F.sum("o_totalprice_missing").alias("missing"), F.sum("high").alias("high"))


@query("pain_bands", """
SELECT l_returnflag, sum(CASE WHEN l_quantity BETWEEN 0 AND 3 THEN 1 ELSE 0 END)::BIGINT AS pain_low,
  sum(CASE WHEN l_quantity BETWEEN 4 AND 6 THEN 1 ELSE 0 END)::BIGINT AS pain_mid,
  sum(CASE WHEN l_quantity BETWEEN 7 AND 10 THEN 1 ELSE 0 END)::BIGINT AS pain_high FROM lineitem GROUP BY 1""")
def pain_bands(spark, sf):
    spec = {"pain_low": (0, 3), "pain_mid": (4, 6), "pain_high": (7, 10)}
    df = C.bands(table(spark, sf, "lineitem", "l_returnflag", "l_quantity"), "l_quantity", spec)
    return df.groupBy("l_returnflag").agg(*[F.sum(c).alias(c) for c in spec])


@query("interactions", f"""
WITH {VISITS}, f AS (SELECT acuity, o_custkey % 100 AS age, o_orderkey % 14 - 1 AS pain,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS ambulance FROM v)
SELECT acuity, sum(age * ambulance)::BIGINT AS age_ambulance, sum((CASE WHEN age >= 65 THEN 1 ELSE 0 END) * ambulance)::BIGINT AS elderly_ambulance,
  sum(least(greatest(pain, 0), 10) * (5 - acuity))::BIGINT AS pain_x_min_severity, sum(age * (5 - acuity))::BIGINT AS age_severity FROM f GROUP BY 1""")
def interactions(spark, sf):
    v = visits(spark, sf).select("acuity", (F.col("o_custkey") % 100).alias("age"), (F.col("o_orderkey") % 14 - 1).alias("pain"),
                                 (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("ambulance")) \
        .withColumn("elderly", (F.col("age") >= 65).cast("int"))
    df = C.interactions(v, {"age_ambulance": ("age", "ambulance"), "elderly_ambulance": ("elderly", "ambulance")})
    df = C.severity_interactions(df, "pain", "age", "acuity")
    return df.groupBy("acuity").agg(*[F.sum(c).cast("bigint").alias(c) for c in (
        "age_ambulance", "elderly_ambulance", "pain_x_min_severity", "age_severity")])


# Text normalisation in SQL, shared by several oracles.
SQL_ABBREV = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ABBREVIATIONS.items()) + "}"


def sql_normalize(col: str) -> str:
    words = f"list_filter(regexp_split_to_array(translate(lower(coalesce({col}, '')), ',;/-().', '       '), '\\s+'), lambda w: length(w) > 0)"
    return (f"array_to_string(list_filter(list_transform({words}, lambda w: coalesce({SQL_ABBREV}[w], "
            f"CASE WHEN length(w) > 1 THEN w END)), lambda w: w IS NOT NULL), ' ')")


@query("count_parts", f"""
SELECT doc_id, CAST(len(list_filter(string_split(text, ','), lambda p: trim(p) <> '')) AS INTEGER) AS n_complaints,
  CAST(length({sql_normalize('text')}) AS INTEGER) AS complaint_length FROM documents""")
def count_parts(spark, sf):
    d = C.count_parts(table(spark, sf, "documents", "doc_id", "text"), "text")
    return d.select("doc_id", "n_complaints", F.length(normalize_text(F.col("text"))).alias("complaint_length"))


# --- defaults ----------------------------------------------------------------------------------------


@query("history_defaults", f"""
WITH h AS (SELECT o_custkey, count(*) AS n, max(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END) AS flag FROM orders
  WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c_mktsegment, sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END)::BIGINT AS no_history, sum(coalesce(flag, 0))::BIGINT AS pmh_flag,
  sum(coalesce(n, 0))::BIGINT AS n_prior_ed_visits, {R('sum(CASE WHEN n IS NULL THEN 9999 ELSE 10 END)')} AS days_since_last_ed
FROM customer LEFT JOIN h ON c_custkey = o_custkey GROUP BY 1""")
def history_defaults(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice") \
        .filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
    block = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_prior_ed_visits"), F.max((F.col("o_totalprice") > 400000).cast("int")).alias("pmh_flag"),
        F.lit(0).alias("no_history"), F.lit(10.0).alias("days_since_last_ed"))
    c = J.left_child(table(spark, sf, "customer", "c_custkey", "c_mktsegment"), block, "c_custkey")
    cols = ["no_history", "pmh_flag", "n_prior_ed_visits"]
    return C.fill_history_defaults(c, ["pmh_flag"]).groupBy("c_mktsegment").agg(
        *[F.sum(x).alias(x) for x in cols], r6(F.sum("days_since_last_ed")).alias("days_since_last_ed"))


@query("med_defaults", """
WITH m AS (SELECT p_brand, count(*) AS n, max(CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END) AS f FROM part WHERE p_size > 45 GROUP BY 1),
b AS (SELECT p_brand, p_type, count(*) AS parts FROM part GROUP BY 1, 2)
SELECT p_type, sum(coalesce(n, 0))::BIGINT AS n_medications, sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END)::BIGINT AS meds_unknown,
  sum(coalesce(f, 0))::BIGINT AS has_promo FROM b LEFT JOIN m ON b.p_brand = m.p_brand AND b.p_type <> 'SMALL' GROUP BY 1""")
def med_defaults(spark, sf):
    p = table(spark, sf, "part", "p_brand", "p_type", "p_size")
    meds = p.filter("p_size > 45").groupBy("p_brand").agg(
        F.count("*").alias("n_medications"), F.max((F.col("p_type") == "PROMO").cast("int")).alias("has_promo"),
        F.lit(0).alias("meds_unknown"))
    stays = p.groupBy("p_brand", "p_type").agg(F.count("*").alias("parts")) \
        .withColumn("key", F.when(F.col("p_type") != "SMALL", F.col("p_brand")))
    joined = J.left_child(stays, meds.withColumnRenamed("p_brand", "key"), "key")
    return C.fill_med_defaults(joined, ["has_promo"]).groupBy("p_type").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("n_medications", "meds_unknown", "has_promo")])


# Word characters and blanks beyond ASCII, as Java's Unicode classes have them.
_SQL_WORD = r"[^\P{L}a-zA-Z]|\p{M}|[^\P{Nd}0-9]|\p{Nl}|[^\P{Pc}_]|[\x{24B6}-\x{24E9}\x{200C}\x{200D}]"
_SQL_BLANK = r"[\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_words(col: str) -> str:
    """Lower-case text in ASCII where it matters: word characters beyond it become an underscore, so that they bound words
    and never make up an ASCII word; only the Kelvin sign has an ASCII letter as lower case."""
    text = f"regexp_replace(replace(coalesce({col}, ''), chr(8490), 'k'), '{_SQL_WORD}', '_', 'g')"
    return f"lower(regexp_replace({text}, '{_SQL_BLANK}', chr(12), 'g'))"


def sql_unnegated(col: str) -> str:
    return f"regexp_replace({sql_words(col)}, '{vocab.HISTORY_NEGATION}', ' _NEG_ ', 'g')"


@query("block_precedence", f"""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS used_record, o_orderkey % 2 AS fl, o_orderkey % 7 AS n FROM orders),
d AS (SELECT doc_id, CASE WHEN regexp_matches({sql_unnegated('text')}, '\\b(?:the)s?\\b') THEN 1 ELSE 0 END AS f FROM documents)
SELECT used_record, CAST(CASE WHEN used_record = 1 THEN fl WHEN f = 1 THEN 1 ELSE 0 END AS INTEGER) AS flag,
  CAST(CASE WHEN used_record = 1 THEN n ELSE 0 END AS INTEGER) AS n_prior, count(*) AS n FROM d JOIN r ON doc_id = o_orderkey GROUP BY 1, 2, 3""")
def block_precedence(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    fields = F.when(F.col("o_orderstatus") == "F", F.to_json(F.struct(F.struct(
        (F.col("o_orderkey") % 2).alias("flag"), (F.col("o_orderkey") % 7).alias("n_prior")).alias("pmh_block")))) \
        .when(F.col("o_orderstatus") == "O", F.lit('{"flag": 1}'))
    rec = o.select(F.col("o_orderkey").alias("doc_id"), parse_block(fields, "flag int, n_prior int", "pmh_block").alias("record"))
    docs = vocab.history_flags(table(spark, sf, "documents", "doc_id", "text"), "text", {"reported": ["the"]})
    out = C.choose_block(docs.join(rec, "doc_id"), "record", {"flag": F.col("reported")}, F.col("reported") == 1,
                         {"flag": 0, "n_prior": 0})
    return out.groupBy("used_record", "flag", "n_prior").agg(F.count("*").alias("n"))


# --- aggregates --------------------------------------------------------------------------------------


@query("first_record", """
SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderpriority)) AS o_orderpriority FROM orders GROUP BY 1""")
def first_record(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderdate", "o_orderpriority")
    return A.first_by(o, ["o_custkey"], "o_orderdate", ["o_orderpriority"])


@query("set_union_flags", """
SELECT l_suppkey, CAST(max(big) AS INTEGER) AS big, CAST(max(cheap) AS INTEGER) AS cheap FROM (
  SELECT l_suppkey, CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END AS big, 0 AS cheap FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_suppkey, 0, CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1""")
def set_union_flags(spark, sf):
    lines = table(spark, sf, "lineitem", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    a = lines.filter("l_returnflag = 'R'").select("l_suppkey", (F.col("l_quantity") > 49).cast("int").alias("big"), F.lit(0).alias("cheap"))
    b = lines.filter("l_returnflag = 'A'").select("l_suppkey", F.lit(0).alias("big"), (F.col("l_discount") > 0.09).cast("int").alias("cheap"))
    return A.union_sets(a, b, ["l_suppkey"], ["big", "cheap"])


@query("mode_group_per_part", """
SELECT l_partkey, l_suppkey AS main_supplier FROM (
  SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS rn
  FROM lineitem GROUP BY l_partkey, l_suppkey) WHERE rn = 1""")
def mode_group_per_part(spark, sf):
    return A.mode_by(table(spark, sf, "lineitem", "l_partkey", "l_suppkey"), ["l_partkey"], "l_suppkey", "main_supplier")


@query("coverage", f"""
SELECT o_orderstatus, count(*) AS n, {R("avg(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END)")} AS large,
  {R("avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)")} AS urgent FROM orders GROUP BY 1""")
def coverage(spark, sf):
    o = table(spark, sf, "orders", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return rounded(A.coverage(o, {"large": F.col("o_totalprice") > 250000, "urgent": F.col("o_orderpriority") == "1-URGENT"},
                              ["o_orderstatus"]), "large", "urgent")


@query("value_distribution", f"""
SELECT o_orderpriority, count(*) AS n, {R('100.0 * count(*) / (SELECT count(*) FROM orders)')} AS pct FROM orders GROUP BY 1""")
def value_distribution(spark, sf):
    return rounded(A.value_distribution(table(spark, sf, "orders", "o_orderpriority"), "o_orderpriority"), "pct")


@query("distinct_counts", """
SELECT 'l_partkey' AS "column", count(DISTINCT l_partkey) AS n_distinct FROM lineitem UNION ALL
SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem""")
def distinct_counts(spark, sf):
    cols = ["l_partkey", "l_suppkey", "l_shipdate"]
    return A.distinct_counts(table(spark, sf, "lineitem", *cols), cols)


@query("summary_stats", f"""
SELECT 'l_quantity' AS "column", {R('avg(l_quantity)')} AS mean, min(l_quantity) AS min, max(l_quantity) AS max, {R('median(l_quantity)')} AS median FROM lineitem
UNION ALL SELECT 'l_extendedprice', {R('avg(l_extendedprice)')}, min(l_extendedprice), max(l_extendedprice), {R('median(l_extendedprice)')} FROM lineitem""")
def summary_stats(spark, sf):
    cols = ["l_quantity", "l_extendedprice"]
    return rounded(A.summary(table(spark, sf, "lineitem", *cols), cols), "mean", "median")


@query("class_weights", f"""
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k FROM c)
SELECT o_orderpriority, n, {R("power(total / (k * n), 0.5) * CASE WHEN o_orderpriority = '1-URGENT' THEN 1.5 ELSE 1 END")} AS weight FROM c, t""")
def class_weights(spark, sf):
    return rounded(A.class_weights(table(spark, sf, "orders", "o_orderpriority"), "o_orderpriority", 0.5, {"1-URGENT": 1.5}), "weight")


@query("pos_weight", f"""
SELECT p, n_pos AS pos, n_neg AS neg, {R('power(n_neg / n_pos, p)')} AS weight FROM (
  SELECT sum(toxic)::BIGINT AS n_pos, (count(*) - sum(toxic))::BIGINT AS n_neg FROM labels), (VALUES (1.0::DOUBLE), (0.5::DOUBLE)) AS x(p)""")
def pos_weight(spark, sf):
    labels = table(spark, sf, "labels", "toxic")
    both = [rounded(A.pos_weight(labels, "toxic", p), "weight").withColumn("p", F.lit(p)) for p in (1.0, 0.5)]
    return both[0].unionByName(both[1])


@query("majority_version", """
WITH p AS (SELECT 'B' || substr(p_brand, 7) AS code, CASE WHEN p_size > 25 THEN '9' WHEN p_size > 3 THEN '10' END AS ver FROM part)
SELECT code, coalesce(max(CASE WHEN rn = 1 THEN ver END), '10') AS version FROM (
  SELECT code, ver, row_number() OVER (PARTITION BY code ORDER BY CASE WHEN ver IS NULL THEN 1 ELSE 0 END, count(*) DESC, ver) AS rn
  FROM p GROUP BY code, ver) GROUP BY code""")
def majority_version(spark, sf):
    p = table(spark, sf, "part", "p_brand", "p_size").select(
        F.concat(F.lit("B"), F.substring("p_brand", 7, 10)).alias("code"),
        F.when(F.col("p_size") > 25, "9").when(F.col("p_size") > 3, "10").alias("ver"))
    return A.majority_version(p, "code", "ver")


_PRIOR_WORDS = """SELECT d.doc_id, quality, unnest(list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda w: length(w) > 0)) AS token
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


@query("token_prior_fit", f"""
SELECT token, {R('avg(quality)')} AS prior, count(quality) AS n FROM ({_PRIOR_WORDS}) WHERE length(token) > 1 AND quality IS NOT NULL
GROUP BY 1 HAVING count(quality) >= 20""")
def token_prior_fit(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.lower("text").alias("text"))
    rows = docs.join(table(spark, sf, "labels", "doc_id", "quality"), "doc_id")
    return rounded(A.fit_token_prior(rows, "text", "quality", 20), "prior")


@query("token_prior_apply", f"""
WITH w AS ({_PRIOR_WORDS}),
p AS (SELECT token, avg(quality) AS prior FROM w WHERE length(token) > 1 AND quality IS NOT NULL GROUP BY 1 HAVING count(quality) >= 20),
s AS (SELECT doc_id, min(prior) AS lo, avg(prior) AS mean, max(prior) AS hi, stddev_pop(prior) AS sd FROM w JOIN p USING (token) GROUP BY 1)
SELECT d.doc_id, {R('coalesce(lo, 3)')} AS min_severity_prior, {R('coalesce(mean, 3)')} AS mean_severity_prior,
  {R('coalesce(hi, 3)')} AS max_severity_prior, {R('coalesce(sd, 0)')} AS std_severity_prior FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""")
def token_prior_apply(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.lower("text").alias("text"))
    prior = A.fit_token_prior(docs.join(table(spark, sf, "labels", "doc_id", "quality"), "doc_id"), "text", "quality", 20)
    out = A.apply_token_prior(docs, "doc_id", "text", prior)
    return rounded(out, *[c for c in out.columns if c != "doc_id"])


@query("standardizer", f"""
WITH s AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp, stddev_pop(p_retailprice) AS sp FROM part)
SELECT p_type, count(*) AS n, {R('sum((p_size - ms) / ss)')} AS size_z, {R('sum((p_retailprice - mp) / sp)')} AS price_z,
  {R('max((p_size - ms) / ss)')} AS max_size_z FROM part, s GROUP BY 1""")
def standardizer(spark, sf):
    p = table(spark, sf, "part", "p_type", "p_size", "p_retailprice")
    z = A.standardize(p, A.fit_standardizer(p, ["p_size", "p_retailprice"]), ["p_size", "p_retailprice"])
    return z.groupBy("p_type").agg(F.count("*").alias("n"), r6(F.sum("p_size_z")).alias("size_z"),
                                   r6(F.sum("p_retailprice_z")).alias("price_z"), r6(F.max("p_size_z")).alias("max_size_z"))


@query("feature_assembly", f"""
WITH {VISITS} SELECT o_orderkey, acuity, score, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS pri_1_urgent,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS pri_4_not_specified FROM v""")
def feature_assembly(spark, sf):
    """Named blocks in order, one-hot columns named after their slugged level."""
    levels = {f"pri_{C.slug(x)}": x for x in ("1-URGENT", "4-NOT SPECIFIED")}
    df = C.one_hot_fixed(visits(spark, sf), "o_orderpriority", levels)
    return C.assemble(df, {"ordinal": ["acuity"], "scores": ["score"], "levels": list(levels)}, ["o_orderkey"])
