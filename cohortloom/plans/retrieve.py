"""Queries of the retrieval layer: index, blends, ranks, recall and graded reports.

Parts stand for coded visits: type = category, brand = code, name = text and title, size and price =
measurements. A 20 % split per type asks the questions, the rest builds the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.codes import code_chapter, code_similarity, rollup_code
from ..functions.parsing import l2_normalize, neg_euclidean
from ..operators import aggregates as A
from ..operators import cases as N
from ..operators import heads as M
from ..operators import retrieval as T
from ..operators import splits as S
from ..operators import vectors as W
from ..session import checkpoint_dir
from ..sources import materialize
from .registry import R, query, r6, rounded, table
from .texts import _TITLES

_Z = ["size_z", "price_z"]
_W2, _W3 = 0.6, {"text": 0.4, "vit": 0.3, "prev": 0.3}
_W4 = {"text": 0.3, "vit": 0.2, "hist": 0.2, "prev": 0.3}


def _stored(spark, sf, name, build):
    """A table of this layer, shared by all its queries: built again only when the parts or the version change."""
    return materialize(spark, f"{checkpoint_dir(spark)}/retrieval/{name}", [f"{sf}/part.parquet"], "1", build)


def _rows(spark, sf):
    """Parts with split, standardised measurements (fitted on the train rows) and a history value. The
    split is stored: vocabulary, vectors, index and questions of all queries read the same rows."""
    def build():
        p = table(spark, sf, "part", "p_partkey", "p_type", "p_brand", "p_name", "p_size", "p_retailprice").withColumns(
            {"hist": (F.col("p_partkey") % 7) / 7.0, "has_hist": (F.col("p_partkey") % 3 == 0)})
        p = S.stratified_split(p, "p_type", "p_partkey", 0.2, 42)
        fitted = A.fit_standardizer(p.filter("split = 'train'"), ["p_size", "p_retailprice"])
        z = A.standardize(p, fitted, ["p_size", "p_retailprice"])
        return z.withColumnsRenamed({"p_size_z": "size_z", "p_retailprice_z": "price_z"})
    return _stored(spark, sf, "rows", build)


def _parts(spark, sf, rows=None, level="brand"):
    rows = _rows(spark, sf) if rows is None else rows
    train = rows.filter("split = 'train'")

    def vectors():
        grams = W.gram_arrays(train, "p_partkey", "p_name")
        n = train.agg(F.count("*")).scalar()
        model = W.fit_tfidf(W.fit_vocabulary(grams, n, 1, 1.0, None), n)
        return W.apply_tfidf(W.gram_arrays(rows, "p_partkey", "p_name"), model, "p_partkey")

    vec = _stored(spark, sf, "vectors", vectors)  # of names, the same for every level of code
    index = T.build_index(train, vec, "p_partkey", "p_type", "p_brand", "p_name", _Z, ["hist"], F.col("has_hist"),
                          lambda name, build: _stored(spark, sf, f"{level}_{name}", build))
    test = rows.filter("split = 'test'")
    return test, vec, index


def _queries(test):
    return test.select("p_partkey", "p_type", "has_hist", "hist", *_Z)


def _terms(spark, sf):
    test, vec, index = _parts(spark, sf)
    terms = T.score_terms(_queries(test), vec, index, "p_partkey", "p_type", "p_brand", _Z, ["hist"])
    return test, terms, index


def _truth(test):
    return test.select("p_partkey", "p_type", "p_brand", "has_hist")


_SPLIT = """hashed AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY md5('42|' || p_partkey), p_partkey) AS pos, count(*) OVER (PARTITION BY p_type) AS nn FROM part),
sp AS (SELECT p_partkey, p_type, p_brand, p_name, p_size, p_retailprice, (p_partkey % 7) / 7.0::DOUBLE AS hist, p_partkey % 3 = 0 AS has_hist,
  CASE WHEN pos <= floor(0.2::DOUBLE * nn + 0.5) THEN 'test' ELSE 'train' END AS split FROM hashed),
fit AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp, stddev_pop(p_retailprice) AS spr FROM sp WHERE split = 'train'),
r AS (SELECT sp.*, (p_size - ms) / ss AS size_z, (p_retailprice - mp) / spr AS price_z FROM sp, fit), tr AS (SELECT * FROM r WHERE split = 'train')"""
_VEC = r"""tok AS (SELECT p_partkey, split, regexp_extract_all(strip_accents(lower(p_name)), '[\p{L}\p{N}_]{2,}') AS t FROM r),
g AS (SELECT p_partkey, split, unnest(t) AS term FROM tok UNION ALL
  SELECT p_partkey, split, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tok WHERE len(t) >= 2 UNION ALL
  SELECT p_partkey, split, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM tok WHERE len(t) >= 3),
c AS (SELECT p_partkey, term, split, count(*) AS tf FROM g GROUP BY ALL), nt AS (SELECT count(*) AS n FROM tr),
voc AS (SELECT term, count(*) AS df FROM c WHERE split = 'train' GROUP BY 1),
xw AS (SELECT p_partkey, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM c JOIN voc USING (term), nt),
vec AS (SELECT p_partkey, term, w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)) AS w FROM xw)"""


def _mm(v: str, part: str) -> str:
    lo, hi = f"min({v}) OVER (PARTITION BY {part})", f"max({v}) OVER (PARTITION BY {part})"
    return f"round(CASE WHEN {hi} - {lo} < 1e-12 THEN 0.5 ELSE ({v} - {lo}) / ({hi} - {lo}) END, 9)"


_INDEX = f"""pv AS (SELECT p_type, p_brand, count(*) AS n, count(*) / (sum(count(*)) OVER (PARTITION BY p_type)) AS prevalence, avg(size_z) AS c_size, avg(price_z) AS c_price,
  coalesce(avg(CASE WHEN has_hist THEN hist END), 0) AS m_hist FROM tr GROUP BY 1, 2),
cand AS (SELECT *, {_mm('prevalence', 'p_type')} AS prev_pos FROM pv),
cs AS (SELECT p_type, p_brand, term, sum(w) AS w FROM vec JOIN tr USING (p_partkey) GROUP BY 1, 2, 3),
cen AS (SELECT p_type, p_brand, term, w / sqrt(sum(w * w) OVER (PARTITION BY p_type, p_brand)) AS w FROM cs)"""
_SCORED = f"""q AS (SELECT * FROM r WHERE split = 'test'),
dots AS (SELECT q.p_partkey, cen.p_brand, round(sum(vec.w * cen.w), 9) AS cos FROM q JOIN vec USING (p_partkey) JOIN cen ON q.p_type = cen.p_type AND vec.term = cen.term GROUP BY 1, 2),
t0 AS (SELECT q.p_partkey, q.p_type, q.has_hist, cand.p_brand, prev_pos, prevalence, coalesce(cos, 0) AS cos,
  round(-sqrt((size_z - c_size) * (size_z - c_size) + (price_z - c_price) * (price_z - c_price)), 9) AS vit, round(-sqrt((hist - m_hist) * (hist - m_hist)), 9) AS hst
  FROM q JOIN cand ON q.p_type = cand.p_type LEFT JOIN dots ON q.p_partkey = dots.p_partkey AND cand.p_brand = dots.p_brand),
terms AS (SELECT *, {_mm('cos', 'p_partkey')} AS text_pos, {_mm('vit', 'p_partkey')} AS vit_pos, {_mm('hst', 'p_partkey')} AS hist_pos FROM t0)"""
_BASE = f"WITH {_SPLIT}, {_VEC}, {_INDEX}, {_SCORED}"
_S2 = "round(0.6 * text_pos + 0.4 * prev_pos, 12)"
_S3 = "round(0.4 * text_pos + 0.3 * vit_pos + 0.3 * prev_pos, 12)"
_S4 = "round(round(0.3 * text_pos + 0.2 * vit_pos + 0.3 * prev_pos, 12) + 0.2 * hist_pos, 12)"
_SG = f"CASE WHEN has_hist THEN {_S4} ELSE {_S3} END"


def _ranked_sql(score: str) -> str:
    return f"ranked AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, p_brand) AS rank FROM (SELECT *, {score} AS score FROM terms))"


def _ranked(terms, score):
    return T.rank_within(terms.withColumn("score", score), ["p_partkey"], "score", ["p_brand"])


# --- index -------------------------------------------------------------------------------------------


@query("prevalence", f"""
SELECT p_type, p_brand, count(*) AS n, {R('count(*) / (sum(count(*)) OVER (PARTITION BY p_type))')} AS prevalence FROM part GROUP BY 1, 2""")
def prevalence(spark, sf):
    return rounded(T.prevalence(table(spark, sf, "part", "p_type", "p_brand"), "p_type", "p_brand"), "prevalence")


@query("code_index", f"""WITH {_SPLIT}, {_VEC}, {_INDEX},
ti AS (SELECT p_type, p_brand, p_name AS title, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY count(*) DESC, p_name) AS rn FROM tr GROUP BY 1, 2, 3)
SELECT cand.p_type, cand.p_brand, n, title, {R('prevalence')} AS prevalence, {R('prev_pos')} AS prev_pos, {R('c_size')} AS c_size_z, {R('c_price')} AS c_price_z, {R('m_hist')} AS m_hist
FROM cand JOIN ti ON cand.p_type = ti.p_type AND cand.p_brand = ti.p_brand AND rn = 1""")
def code_index(spark, sf):
    _, _, index = _parts(spark, sf)
    return rounded(index["candidates"], "prevalence", "prev_pos", "c_size_z", "c_price_z", "m_hist")


# The same index with the first digit of the brand number as the coarser code.
_ROLL = _SPLIT.replace("p_brand, p_name", "substr(p_brand, 1, 7) AS p_brand, p_name")


def _rollup(spark, sf):
    return _parts(spark, sf, rows=_rows(spark, sf).withColumn("p_brand", F.substring("p_brand", 1, 7)), level="group")


@query("code_index_rollup", f"""WITH {_ROLL}, {_VEC}, {_INDEX},
ti AS (SELECT p_type, p_brand, p_name AS title, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY count(*) DESC, p_name) AS rn FROM tr GROUP BY 1, 2, 3)
SELECT cand.p_type, cand.p_brand AS code, n, title, {R('prevalence')} AS prevalence, {R('prev_pos')} AS prev_pos, {R('c_size')} AS c_size_z, {R('c_price')} AS c_price_z, {R('m_hist')} AS m_hist
FROM cand JOIN ti ON cand.p_type = ti.p_type AND cand.p_brand = ti.p_brand AND rn = 1""")
def code_index_rollup(spark, sf):
    _, _, index = _rollup(spark, sf)
    out = rounded(index["candidates"], "prevalence", "prev_pos", "c_size_z", "c_price_z", "m_hist")
    return out.withColumnRenamed("p_brand", "code")


@query("text_centroids", f"WITH {_SPLIT}, {_VEC}, {_INDEX} SELECT p_type, p_brand, term, {R('w')} AS w FROM cen")
def text_centroids(spark, sf):
    _, _, index = _parts(spark, sf)
    return rounded(index["centroids"].select("p_type", "p_brand", "term", "w"), "w")


@query("numeric_centroids", f"""
SELECT p_type, p_brand, {R('avg(p_size)')} AS c_p_size, {R('avg(p_retailprice)')} AS c_p_retailprice FROM part GROUP BY 1, 2""")
def numeric_centroids(spark, sf):
    p = table(spark, sf, "part", "p_type", "p_brand", "p_size", "p_retailprice")
    return rounded(T.numeric_centroids(p, "p_type", "p_brand", ["p_size", "p_retailprice"]), "c_p_size", "c_p_retailprice")


@query("masked_centroids", f"""
SELECT p_type, p_brand, count(*) AS n, {R('coalesce(avg(CASE WHEN p_size > 45 THEN p_retailprice END), 0)')} AS m_p_retailprice FROM part GROUP BY 1, 2""")
def masked_centroids(spark, sf):
    p = table(spark, sf, "part", "p_type", "p_brand", "p_size", "p_retailprice")
    base = p.groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    return rounded(T.attach_centroids(base, p, "p_type", "p_brand", ["p_retailprice"], F.col("p_size") > 45), "m_p_retailprice")


@query("candidate_terms", f"""{_BASE} SELECT p_partkey, p_brand, cos + 0.0 AS cos, vit + 0.0 AS vit, text_pos + 0.0 AS text_pos, vit_pos + 0.0 AS vit_pos,
  hist_pos + 0.0 AS hist_pos, prev_pos + 0.0 AS prev_pos FROM terms""")
def candidate_terms(spark, sf):
    _, terms, _ = _terms(spark, sf)
    cols = ["cos", "vit", "text_pos", "vit_pos", "hist_pos", "prev_pos"]
    return terms.select("p_partkey", "p_brand", *cols)


# --- ranks -------------------------------------------------------------------------------------------


@query("rank_blend2", f"{_BASE}, {_ranked_sql(_S2)} SELECT p_partkey, p_brand, score + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def rank_blend2(spark, sf):
    _, terms, _ = _terms(spark, sf)
    top = T.top_k_within(terms.withColumn("score", T.blend2(_W2)), ["p_partkey"], "score", ["p_brand"], 5)
    return top.select("p_partkey", "p_brand", "score", "rank")


@query("rank_pruned", f"{_BASE}, {_ranked_sql(_S2)} SELECT p_partkey, p_brand, score + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3")
def rank_pruned(spark, sf):
    """The best three of rank_blend2 from the codes that can be among them."""
    test, vec, index = _parts(spark, sf)
    top = T.top_k_pruned(_queries(test), vec, index, "p_partkey", "p_type", "p_brand", _W2, 3)
    return top.select("p_partkey", "p_brand", "score", "rank")


@query("rank_blend3", f"{_BASE}, {_ranked_sql(_S3)} SELECT p_partkey, p_brand, score + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def rank_blend3(spark, sf):
    _, terms, _ = _terms(spark, sf)
    top = T.top_k_within(terms.withColumn("score", T.blend3(_W3)), ["p_partkey"], "score", ["p_brand"], 5)
    return top.select("p_partkey", "p_brand", "score", "rank")


@query("rank_gated", f"{_BASE}, {_ranked_sql(_SG)} SELECT p_partkey, p_brand, score + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def rank_gated(spark, sf):
    _, terms, _ = _terms(spark, sf)
    top = T.top_k_within(terms.withColumn("score", T.gated_blend(_W4, _W3, F.col("has_hist"))), ["p_partkey"], "score", ["p_brand"], 5)
    return top.select("p_partkey", "p_brand", "score", "rank")


@query("score_path", """
SELECT CASE WHEN p_size > 25 AND p_partkey % 3 = 0 THEN 'gated' WHEN p_size > 25 THEN 'vitals' ELSE 'text' END AS path, count(*) AS n FROM part GROUP BY 1""")
def score_path(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_size")
    return p.groupBy(T.choose_path(F.col("p_size") > 25, F.col("p_partkey") % 3 == 0).alias("path")).agg(F.count("*").alias("n"))


# Stage-one stand-in: five of the six types per question with a made-up probability.
_PROBS = """types AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS ti FROM (SELECT DISTINCT p_type FROM part)),
pr0 AS (SELECT p_partkey, types.p_type, ((p_partkey * 31 + ti * 17) % 97 + 1) / 100.0::DOUBLE AS p FROM r, types WHERE split = 'test'),
pr AS (SELECT p_partkey, p_type, p FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY p DESC, p_type) AS rk FROM pr0) WHERE rk <= 5)"""
_MULTI = _SCORED.replace("q AS (SELECT * FROM r WHERE split = 'test')",
                         "q AS (SELECT r.* REPLACE (pr.p_type AS p_type) FROM r JOIN pr ON r.p_partkey = pr.p_partkey)") \
    .replace("GROUP BY 1, 2),", "GROUP BY 1, 2, 3),", 1).replace("SELECT q.p_partkey, cen.p_brand, round", "SELECT q.p_partkey, cen.p_brand, cen.p_type, round") \
    .replace("AND cand.p_brand = dots.p_brand)", "AND cand.p_brand = dots.p_brand AND cand.p_type = dots.p_type)") \
    .replace("PARTITION BY p_partkey", "PARTITION BY p_partkey, p_type")
_FLAT = f"""WITH {_SPLIT}, {_VEC}, {_INDEX}, {_PROBS}, {_MULTI},
pc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, p_type ORDER BY score DESC, p_brand) AS rank FROM (SELECT *, {_S3} AS score FROM terms)) WHERE rank <= 5),
fl AS (SELECT pc.p_partkey, pc.p_type, p_brand, score, rank, p, round(p * score, 12) AS combined FROM pc JOIN pr ON pc.p_partkey = pr.p_partkey AND pc.p_type = pr.p_type)"""


def _resolve(spark, sf, test, vec, index):
    levels = table(spark, sf, "part", "p_type").distinct().agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    probs = test.select("p_partkey").withColumn("types", levels.scalar()) \
        .select("p_partkey", F.posexplode("types").alias("ti", "p_type"))
    probs = probs.select("p_partkey", "p_type", (((F.col("p_partkey") * 31 + (F.col("ti") + 1) * 17) % 97 + 1) / 100.0).alias("p"))
    probs = T.top_k_within(probs, ["p_partkey"], "p", ["p_type"], 5, "cat_rank").drop("cat_rank")
    q = probs.select("p_partkey", "p_type").join(_queries(test).drop("p_type"), "p_partkey")
    terms = T.score_terms(q, vec, index, "p_partkey", "p_type", "p_brand", _Z, ["hist"])
    return probs, T.resolve(terms.withColumn("score", T.blend3(_W3)), probs, "p_partkey", "p_type", "p_brand", "p")


def _resolved(spark, sf):
    test, vec, index = _parts(spark, sf)
    return test, _resolve(spark, sf, test, vec, index)[1]


@query("flat_top10", f"""{_FLAT} SELECT p_partkey, p_type, p_brand, combined + 0.0 AS combined, CAST(fr AS INTEGER) AS flat_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY combined DESC, p_type, p_brand) AS fr FROM fl) WHERE fr <= 10""")
def flat_top10(spark, sf):
    _, out = _resolved(spark, sf)
    return out["flat"].select("p_partkey", "p_type", "p_brand", "combined", "flat_rank")


@query("union_and_best", f"""{_FLAT} SELECT p_partkey, count(*) AS n_codes, max(best) AS best FROM (
  SELECT p_partkey, p_brand, max(combined) AS best FROM fl GROUP BY 1, 2) GROUP BY 1""")
def union_and_best(spark, sf):
    _, out = _resolved(spark, sf)
    per = out["per_category"].withColumn("combined", T.stable(F.col("p") * F.col("score"), 12))
    best = T.best_per_code(per, "p_partkey", "p_brand").groupBy("p_partkey").agg(F.max("combined").alias("best"))
    n = T.union_codes(per, "p_partkey", "p_brand").groupBy("p_partkey").agg(F.count("*").alias("n_codes"))
    return n.join(best, "p_partkey")


@query("top_missed", """
SELECT p_type, p_name, n, CAST(rank AS INTEGER) AS rank FROM (SELECT p_type, p_name, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_name) AS rank
  FROM part WHERE p_size > 25 GROUP BY 1, 2) WHERE rank <= 15""")
def top_missed(spark, sf):
    return T.top_missed(table(spark, sf, "part", "p_type", "p_name", "p_size").filter("p_size > 25"), "p_type", "p_name", 15)


@query("distinct_names", """
WITH f AS (SELECT l_orderkey, lower(p_name) AS k, min((l_linenumber, p_name)) AS f FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
x AS (SELECT l_orderkey, f, row_number() OVER (PARTITION BY l_orderkey ORDER BY f) AS rn FROM f)
SELECT l_orderkey, string_agg(f[2], ', ' ORDER BY rn) AS names FROM x WHERE rn <= 15 GROUP BY 1""")
def distinct_names(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber") \
        .join(table(spark, sf, "part", "p_partkey", "p_name").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    return T.distinct_names(lines, ["l_orderkey"], ["l_linenumber"], "p_name", 15)


@query("first_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 250")
def first_orders(spark, sf):
    return T.take_first(table(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_orderdate", "o_orderkey"], 250) \
        .select("o_orderkey", "o_totalprice")


# --- weight grids ------------------------------------------------------------------------------------


def _grid_sql(names, step):
    points = T.simplex(names, step)
    pos = {"text": "text_pos", "vit": "vit_pos", "hist": "hist_pos", "prev": "prev_pos"}
    values = ", ".join("(" + ", ".join([str(i), *[f"{w[t]}::DOUBLE" for t in names]]) + ")" for i, w in enumerate(points))
    cols = ", ".join(names)
    s = lambda a: "round(" + " + ".join(f"gw.{t} * {a}.{pos[t]}" for t in names) + ", 12)"
    return f"""gw(point, {cols}) AS (VALUES {values}),
truth AS (SELECT p_partkey, p_brand FROM q), tt AS (SELECT terms.* FROM terms JOIN truth USING (p_partkey, p_brand)),
rk AS (SELECT gw.point, a.p_partkey, count(CASE WHEN {s('a')} > {s('b')} OR ({s('a')} = {s('b')} AND a.p_brand < b.p_brand) THEN 1 END) AS better
  FROM gw, terms a JOIN tt b ON a.p_partkey = b.p_partkey GROUP BY 1, 2),
h AS (SELECT point, count(*) AS hits FROM rk WHERE better < 5 GROUP BY 1),
grid AS (SELECT CAST(gw.point AS INTEGER) AS point, {cols}, coalesce(hits, 0) AS hits, (SELECT count(*) FROM q) AS n FROM gw LEFT JOIN h ON gw.point = h.point)"""


@query("weight_grid", f"{_BASE}, {_grid_sql(['text', 'vit', 'prev'], 10)} SELECT *, {R('hits / n')} AS rate FROM grid")
def weight_grid(spark, sf):
    test, terms, _ = _terms(spark, sf)
    out = T.tune(terms, _truth(test), T.simplex(["text", "vit", "prev"], 10), "p_partkey", "p_brand")
    return rounded(out, "rate")


@query("weight_grid_history", f"{_BASE.replace(_SCORED, _SCORED.replace(chr(39) + 'test' + chr(39), chr(39) + 'test' + chr(39) + ' AND has_hist'))}, "
       f"{_grid_sql(['text', 'vit', 'hist', 'prev'], 10)} SELECT *, {R('hits / n')} AS rate FROM grid")
def weight_grid_history(spark, sf):
    """Four-term grid on the questions with history only."""
    test, vec, index = _parts(spark, sf)
    test = test.filter("has_hist")
    terms = T.score_terms(_queries(test), vec, index, "p_partkey", "p_type", "p_brand", _Z, ["hist"])
    out = T.tune(terms, _truth(test), T.simplex(["text", "vit", "hist", "prev"], 10), "p_partkey", "p_brand")
    return rounded(out, "rate")


@query("best_weights", f"""{_BASE}, {_grid_sql(['text', 'vit', 'prev'], 5)}
SELECT point, text, vit, prev, hits FROM grid ORDER BY hits DESC, point LIMIT 1""")
def best_weights(spark, sf):
    test, terms, _ = _terms(spark, sf)
    out = T.tune(terms, _truth(test), T.simplex(["text", "vit", "prev"], 5), "p_partkey", "p_brand")
    return T.best_point(out, "rate").select("point", "text", "vit", "prev", "hits")


# --- recall ------------------------------------------------------------------------------------------

_RECALL = ", ".join(f"{R(f'avg(CASE WHEN rank <= {k} THEN 1 ELSE 0 END)')} AS recall_{k}" for k in (1, 3, 5, 10))
_TRUE_RANK = "tk AS (SELECT q.p_partkey, q.has_hist, min(ranked.rank) AS rank FROM q LEFT JOIN ranked ON q.p_partkey = ranked.p_partkey AND q.p_brand = ranked.p_brand GROUP BY 1, 2)"


@query("oracle_recall", f"{_BASE}, {_ranked_sql(_S3)}, {_TRUE_RANK} SELECT count(*) AS scored, {_RECALL}, {R('avg(coalesce(1 / rank, 0))')} AS mrr FROM tk")
def oracle_recall(spark, sf):
    test, terms, _ = _terms(spark, sf)
    out = T.oracle_recall(_ranked(terms, T.blend3(_W3)), _truth(test), "p_partkey", "p_brand")
    return rounded(out, "recall_1", "recall_3", "recall_5", "recall_10", "mrr")


@query("oracle_recall_rollup", f"WITH {_ROLL}, {_VEC}, {_INDEX}, {_SCORED}, {_ranked_sql(_S3)}, {_TRUE_RANK} SELECT count(*) AS scored, {_RECALL}, {R('avg(coalesce(1 / rank, 0))')} AS mrr FROM tk")
def oracle_recall_rollup(spark, sf):
    """Recall with the coarser code in both the index and the truth."""
    test, vec, index = _rollup(spark, sf)
    terms = T.score_terms(_queries(test), vec, index, "p_partkey", "p_type", "p_brand", _Z, ["hist"])
    out = T.oracle_recall(_ranked(terms, T.blend3(_W3)), _truth(test), "p_partkey", "p_brand")
    return rounded(out, "recall_1", "recall_3", "recall_5", "recall_10", "mrr")


@query("recall_by_subset", f"""{_BASE}, {_ranked_sql(_SG)}, {_TRUE_RANK}, sb AS (SELECT 'all' AS subset, * FROM tk UNION ALL SELECT CASE WHEN has_hist THEN 'history' ELSE 'none' END, * FROM tk)
SELECT subset, count(*) AS scored, {_RECALL}, {R('avg(coalesce(1 / rank, 0))')} AS mrr FROM sb GROUP BY 1""")
def recall_by_subset(spark, sf):
    test, terms, _ = _terms(spark, sf)
    ranks = T.true_ranks(_ranked(terms, T.gated_blend(_W4, _W3, F.col("has_hist"))), _truth(test), "p_partkey", "p_brand") \
        .join(_truth(test), "p_partkey")
    sub = T.by_subset(ranks, {"all": F.lit(True), "history": F.col("has_hist"), "none": ~F.col("has_hist")})
    hit = lambda k: F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0)))
    return sub.groupBy("subset").agg(F.count("*").alias("scored"), *[r6(hit(k)).alias(f"recall_{k}") for k in (1, 3, 5, 10)],
                                     r6(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))).alias("mrr"))


@query("end_to_end_recall", f"""{_FLAT}, tq AS (SELECT p_partkey, p_type, p_brand FROM r WHERE split = 'test'),
bc AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_partkey ORDER BY max(combined) DESC, p_brand) AS fr FROM fl GROUP BY 1, 2),
x AS (SELECT tq.p_partkey, bc.fr, CASE WHEN EXISTS (SELECT 1 FROM fl WHERE fl.p_partkey = tq.p_partkey AND fl.p_type = tq.p_type) THEN 1 ELSE 0 END AS ok
  FROM tq LEFT JOIN bc ON tq.p_partkey = bc.p_partkey AND tq.p_brand = bc.p_brand)
SELECT count(*) AS n, {R('avg(CASE WHEN fr IS NOT NULL THEN 1 ELSE 0 END)')} AS union_recall, {R('avg(CASE WHEN fr <= 10 THEN 1 ELSE 0 END)')} AS flat_recall_10,
  {R('avg(coalesce(1 / fr, 0))')} AS flat_mrr, {R('avg(CASE WHEN ok = 1 THEN CASE WHEN fr IS NOT NULL THEN 1 ELSE 0 END END)')} AS conditional_recall, {R('avg(ok)')} AS category_recall FROM x""")
def end_to_end_recall(spark, sf):
    test, out = _resolved(spark, sf)
    rep = T.end_to_end_recall(out["per_category"], _truth(test), "p_partkey", "p_type", "p_brand", "p")
    return rounded(rep, *[c for c in rep.columns if c != "n"])


# --- the scoring chain -------------------------------------------------------------------------------

# Rules stand for the fitted heads: acuity from the size, admission from price and size, categories by the made-up
# probabilities above. Only visits at the gate or above get categories, a department and codes.
_CHAIN_SQL = """hd AS (SELECT p_partkey, CAST(p_partkey % 5 + 1 AS INTEGER) AS acuity, CAST(floor(p_size / 10.5::DOUBLE) + 1 AS INTEGER) AS acuity_pred, CASE WHEN p_size > 20 THEN 1 ELSE 0 END AS admitted,
  round((p_partkey * 13 % 101) / 200.0::DOUBLE + p_size / 100.0::DOUBLE, 6) AS p_admit, p_type AS diagnosis_group, substr(p_brand, 7, 1) AS service_group, p_brand AS icd_true FROM r WHERE split = 'test'),
fr AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY combined DESC, p_type, p_brand) AS flat_rank FROM fl),
fc AS (SELECT p_partkey, list(p_brand ORDER BY flat_rank) AS icd_flat FROM fr WHERE flat_rank <= 10 GROUP BY 1),
dc AS (SELECT p_partkey, list(p_type ORDER BY p DESC, p_type)[1:3] AS diag_top3 FROM pr GROUP BY 1),
ds AS (SELECT p_partkey, list(dep ORDER BY s DESC, dep)[1:3] AS dept_top3 FROM (SELECT p_partkey, substr(p_brand, 7, 1) AS dep, max(combined) AS s FROM fl GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT hd.*, CASE WHEN p_admit >= 0.4 THEN 1 ELSE 0 END AS admit_pred, CASE WHEN p_admit >= 0.4 THEN diag_top3 END AS diag_top3, CASE WHEN p_admit >= 0.4 THEN dept_top3 END AS dept_top3,
  CASE WHEN p_admit >= 0.4 THEN icd_flat END AS icd_flat FROM hd LEFT JOIN fc USING (p_partkey) LEFT JOIN dc USING (p_partkey) LEFT JOIN ds USING (p_partkey))"""


def _chain_hit(arr: str, val: str, k: int) -> str:
    return R(f"avg(CASE WHEN admitted = 1 THEN CASE WHEN list_contains(coalesce({arr}, [])[1:{k}], {val}) THEN 1 ELSE 0 END END)")


@query("scoring_chain", f"""{_FLAT}, {_CHAIN_SQL}
SELECT 'chain' AS mode, {R('avg(CASE WHEN acuity_pred = acuity THEN 1 ELSE 0 END)')} AS acuity, {R('avg(CASE WHEN admit_pred = admitted THEN 1 ELSE 0 END)')} AS dispo,
  {_chain_hit('diag_top3', 'diagnosis_group', 1)} AS diag_top1, {_chain_hit('diag_top3', 'diagnosis_group', 3)} AS diag_top3, {_chain_hit('dept_top3', 'service_group', 1)} AS dept_top1, {_chain_hit('dept_top3', 'service_group', 3)} AS dept_top3,
  {_chain_hit('icd_flat', 'icd_true', 1)} AS icd_top1, {_chain_hit('icd_flat', 'icd_true', 5)} AS icd_top5, {_chain_hit('icd_flat', 'icd_true', 10)} AS icd_top10,
  count(CASE WHEN admitted = 1 AND diag_top3 IS NOT NULL THEN 1 END) AS diag_cov, count(CASE WHEN admitted = 1 AND dept_top3 IS NOT NULL THEN 1 END) AS dept_cov, count(CASE WHEN admitted = 1 THEN 1 END) AS n_admit,
  count(CASE WHEN admitted = 1 AND icd_flat IS NOT NULL THEN 1 END) AS icd_cov, count(CASE WHEN admitted = 1 THEN 1 END) AS icd_n FROM j""")
def scoring_chain(spark, sf):
    """All held-out visits through the heads in order: acuity, admission, gate, categories, department, codes; then scored.

    The code ranking runs for gated visits only."""
    test, vec, index = _parts(spark, sf)
    heads = test.withColumns({
        "acuity": (F.col("p_partkey") % 5 + 1).cast("int"), "acuity_pred": (F.floor(F.col("p_size") / 10.5) + 1).cast("int"),
        "admitted": (F.col("p_size") > 20).cast("int"),
        "p_admit": F.round((F.col("p_partkey") * 13 % 101) / 200.0 + F.col("p_size") / 100.0, 6)})
    gated = M.gate(heads, "p_admit")
    probs, out = _resolve(spark, sf, gated, vec, index)
    ordered = lambda cols, name: F.transform(F.array_sort(F.collect_list(F.struct(*cols))), lambda x: x[name])
    diag = probs.groupBy("p_partkey").agg(F.slice(ordered([(-F.col("p")).alias("o"), F.col("p_type")], "p_type"), 1, 3).alias("diag_top3"))
    codes = out["flat"].groupBy("p_partkey").agg(ordered(["flat_rank", "p_brand"], "p_brand").alias("icd_flat"))
    dept = out["per_category"].groupBy("p_partkey", F.substring("p_brand", 7, 1).alias("dep")) \
        .agg(F.max(T.stable(F.col("p") * F.col("score"), 12)).alias("s"))
    dept = dept.groupBy("p_partkey").agg(F.slice(ordered([(-F.col("s")).alias("o"), F.col("dep")], "dep"), 1, 3).alias("dept_top3"))
    preds = heads.select("p_partkey", F.lit("chain").alias("mode"), "acuity_pred", (F.col("p_admit") >= M.LIVE_THRESHOLD).cast("int").alias("admit_pred"))
    for part in (diag, dept, codes):
        preds = preds.join(part, "p_partkey", "left")
    truth = heads.select("p_partkey", "acuity", "admitted", F.col("p_type").alias("diagnosis_group"),
                         F.substring("p_brand", 7, 1).alias("service_group"), F.col("p_brand").alias("icd_true"))
    done = N.score_modes(truth, preds, "p_partkey")
    return rounded(done, *[c for c in done.columns if c in ("acuity", "dispo") or "_top" in c])


# --- graded credit -----------------------------------------------------------------------------------

# Brands as codes: letter from the brand number, version from the size; neighbours share rubric or chapter.
def _icd(brand, size):
    num = F.substring(brand, 7, 3).cast("int")
    nine = F.concat(F.lpad((num * 37).cast("string"), 3, "0"), (F.col(size) % 3).cast("string"))
    ten = F.concat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 1 + num % 26, F.lit(1)), F.lpad((num * 4).cast("string"), 2, "0"),
                   (F.col(size) % 3).cast("string"))
    ext = F.concat(F.lit(" e"), F.lpad(num.cast("string"), 3, "0"), F.lit("9"))
    ver = F.when(F.col(size) % 2 == 0, "9").otherwise("10")
    return F.when(F.col(size) == 10, ext).when(ver == "9", nine).otherwise(ten), ver


_CODES = """cd AS (SELECT p_partkey, upper(trim(CASE WHEN p_size = 10 THEN ' e' || lpad(CAST(num AS VARCHAR), 3, '0') || '9' WHEN p_size % 2 = 0 THEN lpad(CAST(num * 37 AS VARCHAR), 3, '0') || p_size % 3
  ELSE substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + num % 26, 1) || lpad(CAST(num * 4 AS VARCHAR), 2, '0') || p_size % 3 END)) AS code, CASE WHEN p_size % 2 = 0 THEN '9' ELSE '10' END AS ver
  FROM (SELECT *, CAST(substr(p_brand, 7) AS INTEGER) AS num FROM part)),
ru AS (SELECT *, CASE WHEN ver = '9' AND code LIKE 'E%' THEN substr(code, 1, 4) ELSE substr(code, 1, 3) END AS rollup, try_cast(substr(code, 1, 3) AS INTEGER) AS n9,
  coalesce(try_cast(substr(code, 2, 2) AS INTEGER), 0) AS n10, substr(code, 1, 1) AS l FROM cd),
ch AS (SELECT *, CASE WHEN ver = '9' THEN CASE WHEN l = 'E' THEN 'external' WHEN l = 'V' THEN 'factors' WHEN n9 IS NULL THEN 'other' WHEN n9 <= 139 THEN 'infectious' WHEN n9 <= 239 THEN 'neoplasms'
    WHEN n9 <= 279 THEN 'endocrine' WHEN n9 <= 289 THEN 'blood' WHEN n9 <= 319 THEN 'mental' WHEN n9 <= 389 THEN 'nervous' WHEN n9 <= 459 THEN 'circulatory' WHEN n9 <= 519 THEN 'respiratory'
    WHEN n9 <= 579 THEN 'digestive' WHEN n9 <= 629 THEN 'genitourinary' WHEN n9 <= 679 THEN 'pregnancy' WHEN n9 <= 709 THEN 'skin' WHEN n9 <= 739 THEN 'musculoskeletal' WHEN n9 <= 759 THEN 'congenital'
    WHEN n9 <= 779 THEN 'perinatal' WHEN n9 <= 799 THEN 'symptoms' WHEN n9 <= 999 THEN 'injury' ELSE 'other' END
  ELSE CASE WHEN l = 'D' THEN CASE WHEN n10 <= 49 THEN 'neoplasms' ELSE 'blood' END WHEN l = 'H' THEN CASE WHEN n10 <= 59 THEN 'eye' ELSE 'ear' END
    WHEN l IN ('V', 'W', 'X', 'Y') THEN 'external' WHEN l IN ('A', 'B') THEN 'infectious' WHEN l = 'C' THEN 'neoplasms' WHEN l = 'E' THEN 'endocrine' WHEN l = 'F' THEN 'mental'
    WHEN l = 'G' THEN 'nervous' WHEN l = 'I' THEN 'circulatory' WHEN l = 'J' THEN 'respiratory' WHEN l = 'K' THEN 'digestive' WHEN l = 'L' THEN 'skin' WHEN l = 'M' THEN 'musculoskeletal'
    WHEN l = 'N' THEN 'genitourinary' WHEN l = 'O' THEN 'pregnancy' WHEN l = 'P' THEN 'perinatal' WHEN l = 'Q' THEN 'congenital' WHEN l = 'R' THEN 'symptoms' WHEN l IN ('S', 'T') THEN 'injury'
    WHEN l = 'U' THEN 'special' WHEN l = 'Z' THEN 'factors' ELSE 'other:' || l END END AS chapter FROM ru)"""


@query("rollup_and_chapter", f"WITH {_CODES} SELECT p_partkey, rollup, chapter FROM ch")
def rollup_and_chapter(spark, sf):
    code, ver = _icd(F.col("p_brand"), "p_size")
    return table(spark, sf, "part", "p_partkey", "p_brand", "p_size").select(
        "p_partkey", rollup_code(code, ver).alias("rollup"), code_chapter(code, ver).alias("chapter"))


@query("code_similarity", f"""WITH {_CODES} SELECT CASE WHEN a.code = b.code THEN 1.0::DOUBLE WHEN a.rollup = b.rollup THEN 0.6::DOUBLE WHEN a.chapter = b.chapter THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS sim,
  count(*) AS n FROM lineitem JOIN ch a ON l_partkey = a.p_partkey JOIN ch b ON l_suppkey = b.p_partkey GROUP BY 1""")
def code_similarity_counts(spark, sf):
    code, ver = _icd(F.col("p_brand"), "p_size")
    coded = table(spark, sf, "part", "p_partkey", "p_brand", "p_size").select("p_partkey", code.alias("code"), ver.alias("ver"))
    pairs = table(spark, sf, "lineitem", "l_partkey", "l_suppkey") \
        .join(coded.select(F.col("p_partkey").alias("l_partkey"), F.col("code").alias("ca"), F.col("ver").alias("va")), "l_partkey") \
        .join(coded.select(F.col("p_partkey").alias("l_suppkey"), F.col("code").alias("cb"), F.col("ver").alias("vb")), "l_suppkey")
    return pairs.groupBy(code_similarity(F.col("ca"), F.col("va"), F.col("cb"), F.col("vb")).alias("sim")).agg(F.count("*").alias("n"))


def _graded_sql(sim: str) -> str:
    return (f"gk AS (SELECT p_partkey, {', '.join(f'coalesce(max(CASE WHEN rank <= {k} THEN {sim} END), 0) AS g{k}' for k in (5, 10))} FROM rs GROUP BY 1) "
            f"SELECT count(*) AS n, {R('avg(g5)')} AS graded_5, {R('avg(g10)')} AS graded_10 FROM gk")


@query("graded_tree", f"""{_BASE}, {_ranked_sql(_S3)}, rs AS (SELECT ranked.p_partkey, rank, CASE WHEN ranked.p_brand = q.p_brand THEN 1 WHEN substr(ranked.p_brand, 1, 3) = substr(q.p_brand, 1, 3) THEN 0.6 ELSE 0 END AS s
  FROM (SELECT p_partkey, rank, 'I' || lpad(substr(p_brand, 7), 2, '0') || '1' AS p_brand FROM ranked) ranked JOIN (SELECT p_partkey, 'I' || lpad(substr(p_brand, 7), 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '2' END AS p_brand FROM q) q ON ranked.p_partkey = q.p_partkey),
rs2 AS (SELECT p_partkey, rank, CASE WHEN s = 0 THEN 0.3 ELSE s END AS s FROM rs), {_graded_sql('s').replace('FROM rs ', 'FROM rs2 ')}""")
def graded_tree(spark, sf):
    """All codes sit in one chapter here, so a miss earns at least the chapter credit."""
    test, terms, _ = _terms(spark, sf)
    as_code = lambda c, tail: F.concat(F.lit("I"), F.lpad(F.substring(c, 7, 2), 2, "0"), tail)
    true = test.select("p_partkey", as_code("p_brand", F.when(F.col("p_partkey") % 2 == 0, "1").otherwise("2")).alias("true_code"))
    ranked = _ranked(terms, T.blend3(_W3)).join(true, "p_partkey").withColumns(
        {"code": as_code("p_brand", F.lit("1")), "ver": F.lit("10")})
    return rounded(T.graded_at_k(T.tree_similarity(ranked, "code", "ver", "true_code", "ver"), "sim", "p_partkey"), "graded_5", "graded_10")


_TITLED = _INDEX + """, ti AS (SELECT p_type, p_brand, title FROM (SELECT p_type, p_brand, p_name AS title, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY count(*) DESC, p_name) AS rn FROM tr GROUP BY 1, 2, 3) WHERE rn = 1)"""
_GT = _TITLES.replace("tok AS", "tok2 AS").replace("FROM tok", "FROM tok2").replace("\ng AS", "\ng2 AS").replace("FROM g GROUP", "FROM g2 GROUP") \
    .replace("\nc AS", "\nc2 AS").replace("FROM c GROUP", "FROM c2 GROUP").replace("FROM c JOIN voc", "FROM c2 JOIN voc2").replace("n AS (SELECT count(*) AS n FROM tt), voc AS", "n2 AS (SELECT count(*) AS n FROM tt), voc2 AS") \
    .replace("USING (term), n)", "USING (term), n2 n)")


@query("graded_title", f"""WITH {_SPLIT}, {_VEC}, {_TITLED}, {_SCORED}, {_ranked_sql(_S3)}, {_GT},
pr AS (SELECT ranked.p_partkey, rank, ti.title AS ta, q.p_name AS tb FROM ranked JOIN ti USING (p_type, p_brand) JOIN q ON ranked.p_partkey = q.p_partkey),
dd AS (SELECT ta, tb, round(sum(a.w * b.w), 9) AS s FROM (SELECT DISTINCT ta, tb FROM pr) JOIN tv a ON a.title = ta JOIN tv b ON b.title = tb AND a.term = b.term GROUP BY 1, 2),
rs AS (SELECT pr.p_partkey, rank, coalesce(s, 0) AS s FROM pr LEFT JOIN dd ON pr.ta = dd.ta AND pr.tb = dd.tb), {_graded_sql('s')}""")
def graded_title(spark, sf):
    test, terms, _ = _terms(spark, sf)
    vecs = W.title_tfidf(table(spark, sf, "part", "p_name"), "p_name")
    ranked = _ranked(terms, T.blend3(_W3)).join(test.select("p_partkey", F.col("p_name").alias("true_title")), "p_partkey")
    scored = W.pair_cosine(ranked, vecs, vecs, "title", "true_title").withColumn("sim", T.stable(F.col("sim")))
    return rounded(T.graded_at_k(scored, "sim", "p_partkey"), "graded_5", "graded_10")


@query("graded_embedding", f"""{_BASE}, {_ranked_sql(_S3)},
e AS (SELECT vec_id, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS v FROM embeddings),
cv AS (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS BIGINT) AS id FROM part),
rs AS (SELECT ranked.p_partkey, rank, round(list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])), 9) AS s FROM ranked JOIN q ON ranked.p_partkey = q.p_partkey JOIN cv ca ON ranked.p_brand = ca.p_brand JOIN cv cb ON q.p_brand = cb.p_brand
  JOIN e a ON ca.id = a.vec_id JOIN e b ON cb.id = b.vec_id), {_graded_sql('s')}""")
def graded_embedding(spark, sf):
    """Stored vectors by code number; the similarity is computed once per distinct code pair."""
    test, terms, _ = _terms(spark, sf)
    e = table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", l2_normalize(F.col("embedding").cast("array<double>")).alias("v"))
    ranked = _ranked(terms, T.blend3(_W3)).join(test.select("p_partkey", F.col("p_brand").alias("true_brand")), "p_partkey")
    num = lambda c: F.substring(c, 7, 3).cast("bigint")
    side = lambda c, v: e.select(F.col("vec_id").alias(c), F.col("v").alias(v))
    pairs = ranked.select("p_brand", "true_brand").distinct().withColumns({"ia": num("p_brand"), "ib": num("true_brand")}) \
        .join(side("ia", "va"), "ia").join(side("ib", "vb"), "ib")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sims = pairs.select("p_brand", "true_brand", T.stable(dot).alias("sim"))
    return rounded(T.graded_at_k(ranked.join(sims, ["p_brand", "true_brand"]), "sim", "p_partkey"), "graded_5", "graded_10")


@query("graded_violations", f"""{_BASE}, {_ranked_sql(_S3)}, {_TRUE_RANK}, gd AS (SELECT ranked.p_partkey, max(CASE WHEN ranked.p_brand = q.p_brand THEN 1 WHEN substr(ranked.p_brand, 1, 7) = substr(q.p_brand, 1, 7) THEN 0.6 ELSE 0 END) AS g
  FROM ranked JOIN q ON ranked.p_partkey = q.p_partkey WHERE rank <= 5 GROUP BY 1)
SELECT count(CASE WHEN g + 1e-9 < CASE WHEN rank <= 5 THEN 1 ELSE 0 END THEN 1 END) AS violations FROM tk JOIN gd USING (p_partkey)""")
def graded_violations(spark, sf):
    test, terms, _ = _terms(spark, sf)
    ranked = _ranked(terms, T.blend3(_W3))
    true = test.select("p_partkey", F.col("p_brand").alias("true_brand"))
    sim = F.when(F.col("p_brand") == F.col("true_brand"), 1.0).when(F.substring("p_brand", 1, 7) == F.substring("true_brand", 1, 7), 0.6).otherwise(0.0)
    graded = ranked.join(true, "p_partkey").filter("rank <= 5").groupBy("p_partkey").agg(F.max(sim).alias("graded"))
    strict = T.true_ranks(ranked, _truth(test), "p_partkey", "p_brand").select("p_partkey", F.coalesce((F.col("rank") <= 5).cast("double"), F.lit(0.0)).alias("strict"))
    return T.violations(strict.join(graded, "p_partkey"), [("strict", "graded")])



@query("before_after_summary", f"""{_BASE}, r2 AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY {_S2} DESC, p_brand) AS rank FROM terms),
r3 AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY {_S3} DESC, p_brand) AS rank FROM terms),
m AS (SELECT 'b' AS side, min(x.rank) AS rank FROM q LEFT JOIN r2 x ON q.p_partkey = x.p_partkey AND q.p_brand = x.p_brand GROUP BY q.p_partkey
  UNION ALL SELECT 'a', min(x.rank) FROM q LEFT JOIN r3 x ON q.p_partkey = x.p_partkey AND q.p_brand = x.p_brand GROUP BY q.p_partkey),
l AS (SELECT side, unnest(['scored', 'recall_1', 'recall_3', 'recall_5', 'recall_10', 'mrr']) AS metric,
  unnest([count(*)::DOUBLE, avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), avg(coalesce(1 / rank, 0))]) AS v FROM m GROUP BY 1)
SELECT 'oracle' AS section, 'full' AS granularity, metric, {R("max(CASE WHEN side = 'b' THEN v END)")} AS before, {R("max(CASE WHEN side = 'a' THEN v END)")} AS after,
  {R("max(CASE WHEN side = 'a' THEN v END) - max(CASE WHEN side = 'b' THEN v END)")} AS delta FROM l GROUP BY metric""")
def before_after_summary(spark, sf):
    """Long summaries of the two-term and the three-term blend, side by side."""
    test, terms, _ = _terms(spark, sf)
    rep = lambda s, v: T.summary_long(T.oracle_recall(_ranked(terms, s), _truth(test), "p_partkey", "p_brand"), "oracle", "icd", "full", v)
    out = T.before_after(rep(T.blend2(_W2), "blend"), rep(T.blend3(_W3), "blend+vitals"), ["section", "granularity", "metric"])
    return rounded(out, "before", "after", "delta")


@query("vector_distance", f"""
SELECT a.vec_id, {R('-sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))))', 5)} AS sim
FROM embeddings a JOIN embeddings b ON b.vec_id = a.label""")
def vector_distance(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label").withColumn("embedding", F.col("embedding").cast("array<double>"))
    ref = e.select(F.col("vec_id").cast("int").alias("label"), F.col("embedding").alias("ref"))
    return e.join(ref, "label").select("vec_id", r6(neg_euclidean(F.col("embedding"), F.col("ref")), 5).alias("sim"))
