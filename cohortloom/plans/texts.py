"""Queries of the text layer: normalisation, flags, vectors, set scores, intake parsing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as X
from ..functions import vocab as V
from ..operators import grams as G
from ..operators import joins as J
from ..operators import splits as S
from ..operators import vectors as W
from ..session import checkpoint_dir, durable
from ..sources import read_notes
from .cohort import sql_normalize, sql_unnegated, sql_words
from .registry import R, query, r6, rounded, table

# The synthetic prose has no clinical words, so these vocabularies use words that do occur.
DOC_VOCAB = {"north": ["the", "was"], "west": ["que", "des"], "mid": ["der", "und", "von"], "sound": ["thin", "then", "than"], "pair": ["in the", "of the"]}
PART_CLASSES = {"has_tools": ["bolt", "gear", "anvil"], "has_rings": ["ring", "red widget"], "has_sheet": ["plate", "gizmo"]}
PART_NAMES = {"has_tools": ["bolt", "hot"], "has_rings": ["ring", "gold"], "has_sheet": ["plate", "small"]}


def sql_ascii(col: str) -> str:
    """Lower-case text with every other letter replaced by an ASCII one, so that word bounds agree."""
    return f"regexp_replace(lower(coalesce({col}, '')), '[^\\x00-\\x7F]', 'x', 'g')"


def sql_flag(text: str, terms) -> str:
    return f"CAST(CASE WHEN regexp_matches({text}, '{V.keyword_pattern(terms)}') THEN 1 ELSE 0 END AS INTEGER)"


def sql_neutral(text: str, negation: str) -> str:
    return f"regexp_replace({text}, '{negation}', ' _NEG_ ', 'g')"


@query("normalize_docs", f"SELECT doc_id, md5({sql_normalize('text')}) AS digest FROM documents")
def normalize_docs(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("digest"))


# Words and what stands between them; a pair of words one blank apart is rewritten at its first word.
_PAIR = "((lower(w[{i}]) = 'of' AND w[{i} + 1] = ' ' AND lower(w[{i} + 2]) = 'the') OR (lower(w[{i}]) = 'de' AND w[{i} + 1] = ' ' AND lower(w[{i} + 2]) = 'la'))"


@query("rewrite_phrases", f"""
WITH t AS (SELECT conv_id, turn, list_concat(['', ''], list_concat(regexp_extract_all(replace(coalesce(text, ''), '’', chr(39)), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), ['', ''])) AS w FROM conversations)
SELECT conv_id, turn, md5(list_aggregate(list_transform(range(3, len(w) - 1), lambda i: CASE
  WHEN {_PAIR.format(i='i')} THEN CASE WHEN lower(w[i]) = 'of' THEN 'OF-THE' ELSE 'DE-LA' END
  WHEN {_PAIR.format(i='(i - 1)')} OR {_PAIR.format(i='(i - 2)')} THEN ''
  WHEN lower(w[i]) IN ('the', 'la', 'in') THEN upper(w[i]) ELSE w[i] END), 'string_agg', '')) AS digest FROM t""")
def rewrite_phrases(spark, sf):
    """Conversation turns with frequent short phrases rewritten, longest phrase first."""
    phrases = {"of the": "OF-THE", "the": "THE", "de la": "DE-LA", "la": "LA", "in": "IN"}
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", F.md5(X.rewrite_phrases(F.col("text"), phrases)).alias("digest"))


@query("negated_flags", f"""
WITH t AS (SELECT doc_id, {sql_neutral(sql_ascii("replace(text, 'der ', 'no ')"), V.HISTORY_NEGATION)} AS x FROM documents)
SELECT doc_id, {', '.join(f'{sql_flag("x", terms)} AS {cat}' for cat, terms in DOC_VOCAB.items())} FROM t""")
def negated_flags(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").withColumn("text", F.replace("text", F.lit("der "), F.lit("no ")))
    return V.history_flags(d, "text", DOC_VOCAB).drop("text")


@query("class_flags", f"""
SELECT p_name, {', '.join(f"{sql_flag(sql_neutral(sql_ascii('d'), V.CLASS_NEGATION), t)} AS {c}" for c, t in PART_CLASSES.items())},
  {sql_flag(sql_neutral(sql_ascii('d'), V.CLASS_NEGATION), ['opioid'])} AS has_opioid, count(*) AS n
FROM (SELECT p_name, p_name || 's, ' || CASE WHEN p_size > 25 THEN 'non-opioid' ELSE 'opioids' END AS d FROM part) GROUP BY ALL""")
def class_flags(spark, sf):
    p = table(spark, sf, "part", "p_name", "p_size").withColumn("d", F.concat(
        F.col("p_name"), F.lit("s, "), F.when(F.col("p_size") > 25, "non-opioid").otherwise("opioids")))
    vocab = {**PART_CLASSES, "has_opioid": ["opioid"]}
    return V.class_flags(p, "d", vocab).groupBy("p_name", *vocab).agg(F.count("*").alias("n"))


_TOKEN_VALUES = ", ".join(f"('{k}', '{c}')" for c, ks in PART_NAMES.items() for k in ks)


@query("token_flags", f"""
WITH v(keyword, category) AS (VALUES {_TOKEN_VALUES}),
t AS (SELECT p_partkey, unnest(list_distinct(regexp_extract_all(lower(p_name), '[a-z]+'))) AS keyword FROM part)
SELECT DISTINCT p_partkey, category FROM t JOIN v USING (keyword)""")
def token_flags(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name").withColumn("tokens", V.name_tokens(F.col("p_name")))
    return J.flag_by_token(p, "tokens", V.vocab_table(spark, PART_NAMES)).select("p_partkey", "category").distinct()


def _sql_row_flag(cat: str, name: str, desc: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in PART_NAMES[cat])
    by_class = sql_flag(sql_neutral(sql_ascii(desc), V.CLASS_NEGATION), PART_CLASSES[cat])
    return f"greatest(CAST(list_has_any(regexp_extract_all(lower({name}), '[a-z]+'), [{tokens}]) AS INTEGER), {by_class})"


@query("row_flags", f"""
SELECT p_name, p_type, {', '.join(f"{_sql_row_flag(c, 'p_name', 'd')} AS {c}" for c in PART_NAMES)}, count(*) AS n
FROM (SELECT p_name, p_type, CASE WHEN p_type = 'PROMO' THEN 'Red Widgets and gears' ELSE p_type END AS d FROM part) GROUP BY ALL""")
def row_flags(spark, sf):
    p = table(spark, sf, "part", "p_name", "p_type").withColumn(
        "d", F.when(F.col("p_type") == "PROMO", "Red Widgets and gears").otherwise(F.col("p_type")))
    return V.row_flags(p, "p_name", "d", PART_NAMES, PART_CLASSES).groupBy("p_name", "p_type", *PART_NAMES).agg(F.count("*").alias("n"))


@query("med_block", f"""
SELECT l_orderkey, count(*) AS n_medications, CAST(0 AS INTEGER) AS meds_unknown,
  {', '.join(f"max({_sql_row_flag(c, 'p_name', 'p_type')}) AS {c}" for c in PART_NAMES)} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def med_block(spark, sf):
    """Medication block per order: flags are raised once per part, then joined and OR-ed."""
    p = V.row_flags(table(spark, sf, "part", "p_partkey", "p_name", "p_type"), "p_name", "p_type", PART_NAMES, PART_CLASSES)
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_partkey").withColumnRenamed("l_partkey", "p_partkey")
    return lines.join(p, "p_partkey").groupBy("l_orderkey").agg(
        F.count("*").alias("n_medications"), F.lit(0).alias("meds_unknown"), *[F.max(c).alias(c) for c in PART_NAMES])


# A line's own part and the part its supplier key points at form one reported list.
@query("free_list", f"""
WITH l AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'None' ELSE a.p_name || ' and ' || coalesce(b.p_name, '') || '; ' END AS t
  FROM lineitem JOIN part a ON l_partkey = a.p_partkey LEFT JOIN part b ON l_suppkey = b.p_partkey AND l_linenumber <> 1),
f AS (SELECT CASE WHEN t = 'None' THEN 0 ELSE len(list_filter(string_split(replace(replace(lower(t), ';', ','), ' and ', ','), ','), lambda p: trim(p) <> '')) END::BIGINT AS n_medications,
  CAST(t = 'None' AS INTEGER) AS meds_unknown, {', '.join(f"CASE WHEN t = 'None' THEN 0 ELSE {_sql_row_flag(c, 't', 't')} END AS {c}" for c in PART_NAMES)} FROM l)
SELECT *, count(*) AS n FROM f GROUP BY ALL""")
def free_list(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name")
    lines = table(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag") \
        .withColumn("other", F.when(F.col("l_linenumber") != 1, F.col("l_suppkey")))
    both = lines.join(p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("a")), "l_partkey") \
        .join(p.select(F.col("p_partkey").alias("other"), F.col("p_name").alias("b")), "other", "left")
    said = F.when(F.col("l_returnflag") == "N", "None").otherwise(
        F.concat("a", F.lit(" and "), F.coalesce("b", F.lit("")), F.lit("; ")))
    out = V.classify_free_list(both.select(said.alias("t")), "t", PART_NAMES, PART_CLASSES)
    return out.groupBy("n_medications", "meds_unknown", *PART_NAMES).agg(F.count("*").alias("n"))


@query("section_extract", r"""
WITH n AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'Chief Complaint: x' || chr(10) || ' PMHx : ' || text || chr(10) || 'Social  History: none'
  WHEN lang = 'fr' THEN 'Past Medical History:' || chr(10) || text ELSE text END AS note FROM documents)
SELECT doc_id, md5(regexp_replace(CASE WHEN note LIKE 'Past%' THEN substr(note, 23) WHEN note LIKE 'Chief%' THEN
  substr(note, position('PMHx : ' IN note) + 7, position(chr(10) || 'Social  History: none' IN note) - position('PMHx : ' IN note) - 7)
  ELSE '' END, '^\s+|\s+$', '', 'g')) AS digest FROM n""")
def section_extract(spark, sf):
    t, nl = F.col("text"), F.lit("\n")
    note = (F.when(F.col("lang") == "en", F.concat(F.lit("Chief Complaint: x\n PMHx : "), t, F.lit("\nSocial  History: none")))
            .when(F.col("lang") == "fr", F.concat(F.lit("Past Medical History:"), nl, t)).otherwise(t))
    return table(spark, sf, "documents", "doc_id", "text", "lang").select("doc_id", F.md5(X.extract_section(note)).alias("digest"))


@query("token_sets", """
SELECT doc_id, len(s) AS n_tokens, array_to_string(list_sort(s), ' ') AS tokens FROM (
  SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: length(t) > 2)) AS s FROM documents)""")
def token_sets(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").withColumn("s", X.token_set(F.col("text")))
    return d.select("doc_id", F.size("s").cast("bigint").alias("n_tokens"), F.array_join(F.array_sort("s"), " ").alias("tokens"))


# --- vectors -----------------------------------------------------------------------------------------

_GRAMS = r"""tok AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS t FROM documents),
g AS (SELECT doc_id, unnest(t) AS term FROM tok
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tok WHERE len(t) >= 2
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM tok WHERE len(t) >= 3),
c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
voc AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM c, n GROUP BY term, n.n
  HAVING count(*) >= 20 AND count(*) <= 0.95::DOUBLE * n.n ORDER BY cf DESC, term LIMIT 2000)"""


def _n_docs(spark, sf):
    return table(spark, sf, "documents", "doc_id").agg(F.count("*")).scalar()


@query("ngram_counts", f"WITH {_GRAMS} SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_grams, max(tf) AS top_tf FROM c GROUP BY 1")
def ngram_counts(spark, sf):
    return W.gram_totals(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


@query("tfidf_vocab", f"WITH {_GRAMS} SELECT term, df, cf FROM voc")
def tfidf_vocab(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return G.fit_grams(d, "doc_id", "text", _n_docs(spark, sf))[0]


@query("tfidf_weights", f"""
WITH {_GRAMS}, w AS (SELECT c.doc_id, c.term, (1 + ln(tf)) * (ln((1.0::DOUBLE + n.n) / (1 + df)) + 1) AS w FROM c JOIN voc USING (term), n),
l AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1)
SELECT w.doc_id, term, {R('w / norm')} AS w FROM w JOIN l ON w.doc_id = l.doc_id""")
def tfidf_weights(spark, sf):
    n = _n_docs(spark, sf)
    vocabulary, found = G.fit_grams(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", n)
    return rounded(W.weigh(found, W.fit_tfidf(vocabulary, n), "doc_id"), "w")


_TITLES = r"""tt AS (SELECT DISTINCT p_name AS title FROM part), tok AS (SELECT title, regexp_extract_all(lower(title), '[\p{L}\p{N}_]{1,}') AS t FROM tt),
g AS (SELECT title, unnest(t) AS term FROM tok UNION ALL
  SELECT title, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tok WHERE len(t) >= 2),
c AS (SELECT title, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM tt), voc AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
x AS (SELECT title, term, tf * (ln((1.0::DOUBLE + n.n) / (1 + df)) + 1) AS w FROM c JOIN voc USING (term), n),
tv AS (SELECT title, term, w / sqrt(sum(w * w) OVER (PARTITION BY title)) AS w FROM x)"""


@query("title_tfidf", f"WITH {_TITLES} SELECT title AS p_name, term, {R('w')} AS w FROM tv")
def title_tfidf(spark, sf):
    return rounded(W.title_tfidf(table(spark, sf, "part", "p_name"), "p_name"), "w")


@query("title_similarity", f"""
WITH {_TITLES}, pairs AS (SELECT DISTINCT a.p_name AS ta, b.p_name AS tb FROM lineitem l JOIN part a ON l_partkey = a.p_partkey JOIN part b ON l_suppkey = b.p_partkey),
d AS (SELECT ta, tb, sum(a.w * b.w) AS s FROM pairs JOIN tv a ON a.title = ta JOIN tv b ON b.title = tb AND a.term = b.term GROUP BY 1, 2)
SELECT p.ta, p.tb, {R('coalesce(s, 0)')} AS sim FROM pairs p LEFT JOIN d ON p.ta = d.ta AND p.tb = d.tb""")
def title_similarity(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name")
    pairs = table(spark, sf, "lineitem", "l_partkey", "l_suppkey") \
        .join(p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("ta")), "l_partkey") \
        .join(p.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("tb")), "l_suppkey").select("ta", "tb").distinct()
    vecs = W.title_tfidf(p, "p_name")
    return rounded(W.pair_cosine(pairs, vecs, vecs, "ta", "tb"), "sim")


@query("lookup_vectors", f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label < 8)
SELECT d.vec_id, {R("CASE WHEN v IS NULL THEN 0 ELSE v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))) END", 5)} AS first,
  {R("CASE WHEN v IS NULL THEN 0 ELSE list_sum(list_transform(v, lambda x: x * x)) / list_sum(list_transform(v, lambda x: x * x)) END", 5)} AS norm
FROM embeddings d LEFT JOIN e ON d.vec_id = e.vec_id""")
def lookup_vectors(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    out = W.lookup_vectors(e.select("vec_id"), "vec_id", e.filter("label < 8"), "embedding", 64)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return out.select("vec_id", r6(F.get("embedding", F.lit(0)), 5).alias("first"), r6(norm, 5).alias("norm"))


@query("missing_titles", """
SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 3)""")
def missing_titles(spark, sf):
    p = table(spark, sf, "part", "p_name", "p_size")
    return W.missing_titles(p, "p_name", p.filter("p_size < 3"))


# --- set scores --------------------------------------------------------------------------------------

_TURNS = """p AS (SELECT a.conv_id, a.turn, list_distinct(list_filter(regexp_extract_all(lower(a.text), '[a-z]+'), lambda t: length(t) > 2)) AS x,
  list_distinct(list_filter(regexp_extract_all(lower(b.text), '[a-z]+'), lambda t: length(t) > 2)) AS y
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _turns(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), X.token_set(F.col("text")).alias("y"))
    return c.select("conv_id", "turn", X.token_set(F.col("text")).alias("x")).join(nxt, ["conv_id", "turn"])


@query("jaccard_turns", f"""
WITH {_TURNS} SELECT conv_id, turn, {R("CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END")} AS jaccard FROM p""")
def jaccard_turns(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", r6(X.jaccard(F.col("x"), F.col("y"))).alias("jaccard"))


@query("token_prf", f"""
WITH {_TURNS}, s AS (SELECT conv_id, turn, len(x) AS a, len(y) AS b, len(list_intersect(x, y)) AS i FROM p),
q AS (SELECT conv_id, turn, CASE WHEN a = 0 AND b = 0 THEN 1 WHEN b = 0 THEN 0 ELSE i / b END AS pr, CASE WHEN a = 0 AND b = 0 THEN 1 WHEN a = 0 THEN 0 ELSE i / a END AS rc FROM s)
SELECT conv_id, turn, {R('pr')} AS "precision", {R('rc')} AS recall, {R('CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END')} AS f1 FROM q""")
def token_prf(spark, sf):
    prf = X.token_prf(F.col("x"), F.col("y"))
    return _turns(spark, sf).select("conv_id", "turn", *[r6(c).alias(n) for n, c in prf.items()])


@query("self_report_gap", f"""
WITH t AS (SELECT doc_id, {sql_ascii('text')} AS x FROM documents), f AS (SELECT doc_id, {', '.join(f'{sql_flag("x", terms)} AS {cat}' for cat, terms in DOC_VOCAB.items())} FROM t),
r AS (SELECT doc_id, quality, toxic FROM labels)
SELECT f.doc_id, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {c} = 1 THEN '{c}' END" for c in DOC_VOCAB)}],
  lambda c: c IS NOT NULL AND NOT (c = 'north' AND quality = 1) AND NOT (c = 'west' AND toxic = 1))), ',') AS gap FROM f JOIN r ON f.doc_id = r.doc_id""")
def self_report_gap(spark, sf):
    d = V.text_flags(table(spark, sf, "documents", "doc_id", "text"), "text", DOC_VOCAB, negation=r"\bnosuchcue\b")
    rec = table(spark, sf, "labels", "doc_id", "quality", "toxic").select(
        "doc_id", V.flag_set({"north": "quality", "west": "toxic"}).alias("recorded"))
    out = d.join(rec, "doc_id")
    return out.select("doc_id", F.array_join(V.self_report_gap(V.flag_set({c: c for c in DOC_VOCAB}), F.col("recorded")), ",").alias("gap"))


@query("self_report_gap_meds", f"""
WITH p AS (SELECT p_partkey, p_size, {', '.join(f"{_sql_row_flag(c, 'p_name', 'p_name')} AS {c}" for c in PART_NAMES)} FROM part)
SELECT p_partkey, CASE WHEN p_size > 40 THEN '' ELSE array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {c} = 1 THEN '{c}' END" for c in PART_NAMES)}],
  lambda c: c IS NOT NULL AND NOT (c = 'has_tools' AND p_size % 2 = 0))), ',') END AS gap FROM p""")
def self_report_gap_meds(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_size").withColumn(
        "said", F.when(F.col("p_size") > 40, " IDK ").otherwise(F.col("p_name")))
    f = V.classify_free_list(p, "said", PART_NAMES, PART_CLASSES)
    rec = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("has_tools"))).otherwise(F.array().cast("array<string>"))
    return f.select("p_partkey", F.array_join(V.self_report_gap(V.flag_set({c: c for c in PART_NAMES}), rec), ",").alias("gap"))


@query("flag_phrases", """
SELECT p_partkey, concat_ws(', ', CASE WHEN p_size > 20 THEN 'anemia' END, CASE WHEN p_type = 'PROMO' THEN 'gerd' END, CASE WHEN p_size % 2 = 1 THEN 'copd' END) AS phrases FROM part""")
def flag_phrases(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_size", "p_type").withColumns({
        "a": (F.col("p_size") > 20).cast("int"), "d": (F.col("p_type") == "PROMO").cast("int"), "r": (F.col("p_size") % 2).cast("int")})
    return p.select("p_partkey", V.flags_to_phrases({"Blood and Blood-Forming Organs": "a", "Digestive": "d", "Respiratory": "r"}).alias("phrases"))


@query("vocabulary_agreement", f"""
WITH p AS (SELECT p_partkey, p_name, {', '.join(f"CAST(list_has_any(regexp_extract_all(lower(p_name), '[a-z]+'), [{', '.join(repr(t) for t in PART_NAMES[c])}]) AS INTEGER) AS a_{c}, {sql_flag(sql_ascii('p_name'), PART_CLASSES[c])} AS b_{c}" for c in PART_NAMES)} FROM part),
s AS (SELECT l_suppkey, {', '.join(f'max(a_{c}) AS a_{c}, max(b_{c}) AS b_{c}' for c in PART_NAMES)} FROM lineitem JOIN p ON l_partkey = p_partkey GROUP BY 1),
l AS ({' UNION ALL '.join(f"SELECT '{c}' AS category, a_{c} AS a, b_{c} AS b FROM s" for c in PART_NAMES)})
SELECT category, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sum(a * b)::BIGINT AS n_both, sum(a * (1 - b))::BIGINT AS only_a, sum(b * (1 - a))::BIGINT AS only_b,
  {R('avg(CASE WHEN a = b THEN 1 ELSE 0 END)')} AS agreement, {R('CASE WHEN sum(greatest(a, b)) = 0 THEN 1 ELSE sum(a * b) / sum(greatest(a, b)) END')} AS jaccard FROM l GROUP BY 1""")
def vocabulary_agreement(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name").withColumnRenamed("p_partkey", "l_partkey")
    lines = table(spark, sf, "lineitem", "l_partkey", "l_suppkey")
    flagged = V.class_flags(V.name_flags(p, "p_name", PART_NAMES, {c: f"a_{c}" for c in PART_NAMES}), "p_name", PART_CLASSES, {c: f"b_{c}" for c in PART_NAMES})
    rows = lines.join(flagged, "l_partkey").groupBy("l_suppkey").agg(*[F.max(f"{s}_{c}").alias(f"{s}_{c}") for s in "ab" for c in PART_NAMES])
    side = lambda s: rows.select("l_suppkey", *[F.col(f"{s}_{c}").alias(c) for c in PART_NAMES])
    return rounded(S.vocabulary_agreement(side("a"), side("b"), ["l_suppkey"], list(PART_NAMES)), "agreement", "jaccard")


# --- intake answers and loose JSON -------------------------------------------------------------------


@query("intake_answers", f"""
SELECT l_returnflag, count(num) AS n_num, {R('sum(num)', 4)} AS num, {R('sum(sbp)')} AS sbp, {R('sum(dbp)')} AS dbp, {R('sum(clock)')} AS clock, count(clock) AS n_clock FROM (
  SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS num, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_partkey END AS sbp,
    CASE WHEN l_linenumber IN (2, 3) THEN NULL ELSE l_suppkey END AS dbp,
    CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN (l_suppkey % 24) * 60 + l_partkey % 60 ELSE l_linenumber END AS clock FROM lineitem) GROUP BY 1""")
def intake_answers(spark, sf):
    lines = table(spark, sf, "lineitem", "l_returnflag", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    no, s = F.col("l_linenumber"), lambda c: F.col(c).cast("string")
    num = F.when(no == 1, " Not sure ").when(no == 2, F.concat(F.lit("about "), s("l_quantity"), F.lit(" bpm"))).otherwise(s("l_quantity"))
    bp = F.when(no == 2, "n/a").when(no == 3, s("l_partkey")).when(no == 4, F.concat(s("l_partkey"), F.lit(" over "), s("l_suppkey"))) \
        .otherwise(F.concat(s("l_partkey"), F.lit("/"), s("l_suppkey")))
    clock = F.when(no == 1, "now").when(no == 2, F.concat((F.col("l_suppkey") % 24).cast("string"), F.lit(":"),
                                                          F.lpad((F.col("l_partkey") % 60).cast("string"), 2, "0"))) \
        .otherwise(F.concat(F.lit("+"), s("l_linenumber"), F.lit(" min")))
    got = lines.select("l_returnflag", P.parse_number(num).alias("num"), P.parse_bp(bp).alias("bp"), P.parse_clock(clock).alias("clock"))
    return got.groupBy("l_returnflag").agg(
        F.count("num").alias("n_num"), r6(F.sum("num"), 4).alias("num"), r6(F.sum("bp.sbp")).alias("sbp"), r6(F.sum("bp.dbp")).alias("dbp"),
        r6(F.sum("clock")).alias("clock"), F.count("clock").alias("n_clock"))


@query("json_or_raw", r"""
SELECT conv_id, turn, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM conversations""")
def json_or_raw(spark, sf):
    """Turns wrapped as fenced JSON (even turns) or left as prose (odd turns); both give the text back."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("text").alias("narrative"))), F.lit("\n```"))
    raw = F.when(F.col("turn") % 2 == 0, fenced).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.md5(P.json_field_or_raw(raw, "narrative")).alias("digest"))


@query("table_vocabulary", f"""
WITH v AS (SELECT DISTINCT lower(p_name) AS k, CASE WHEN p_name LIKE '% widget' THEN 'widget' ELSE 'other' END AS c FROM part WHERE p_size % 7 <> 0),
t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN string_agg(p_name, '; ' ORDER BY l_linenumber, p_name) ELSE string_agg(p_name, '; denies ' ORDER BY l_linenumber, p_name) END AS x
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1),
w AS (SELECT o_orderkey, {sql_neutral(sql_ascii('x'), V.HISTORY_NEGATION)} AS x FROM t),
f AS (SELECT w.o_orderkey, max(CASE WHEN c = 'widget' THEN 1 ELSE 0 END) AS widget, max(CASE WHEN c = 'other' THEN 1 ELSE 0 END) AS other
  FROM w JOIN v ON regexp_matches(w.x, '\\b' || v.k || 's?\\b') GROUP BY 1)
SELECT w.o_orderkey, CAST(coalesce(widget, 0) AS INTEGER) AS widget, CAST(coalesce(other, 0) AS INTEGER) AS other FROM w LEFT JOIN f ON f.o_orderkey = w.o_orderkey""")
def table_vocabulary(spark, sf):
    """Flags from a (keyword, category) table whose keywords have two words."""
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_size")
    words = p.filter("p_size % 7 <> 0").select(F.lower("p_name").alias("keyword"), F.when(
        F.col("p_name").endswith(" widget"), "widget").otherwise("other").alias("category"))
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber").join(p, F.col("l_partkey") == F.col("p_partkey"))
    names = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("n"))
    gap = F.when(F.col("o_orderkey") % 2 == 0, "; ").otherwise("; denies ")
    text = F.expr("aggregate(n, '', (a, x) -> concat(a, if(a = '', '', gap), x.p_name))")
    notes = table(spark, sf, "orders", "o_orderkey").join(names, "o_orderkey").withColumn("gap", gap).withColumn("x", text)
    return V.history_flags(notes, "x", words, keep=["o_orderkey"]).select("o_orderkey", "widget", "other")


# The first two and three words of every document as a dictionary, looked up in all documents.
_PARTS = r"regexp_extract_all({}, '[^a-z0-9_]*[a-z0-9_]+')"


@query("phrase_flags", f"""
WITH k AS (SELECT DISTINCT regexp_extract({sql_words('text')}, '^[a-z]+ [a-z]+' || x) AS k, doc_id % 3 AS c FROM documents, (VALUES (''), (' [a-z]+')) v(x)),
p AS (SELECT k, c FROM k WHERE k <> '' UNION SELECT k || 's', c FROM k WHERE k <> ''),
t AS (SELECT doc_id, {_PARTS.format(sql_unnegated("replace(text, 'der ', 'no ')"))} AS w FROM documents),
r AS (SELECT doc_id, unnest(list_distinct(list_concat(
  list_transform(range(1, len(w)), lambda i: regexp_extract(w[i], '[a-z0-9_]+$') || w[i + 1]),
  list_transform(range(1, len(w) - 1), lambda i: regexp_extract(w[i], '[a-z0-9_]+$') || w[i + 1] || w[i + 2])))) AS k FROM t),
h AS (SELECT doc_id, c FROM r JOIN p USING (k))
SELECT d.doc_id, {', '.join(f"CAST(coalesce(bool_or(c = {i}), false) AS INTEGER) AS c{i}" for i in range(3))} FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY 1""")
def phrase_flags(spark, sf):
    """Negation-aware flags from a stored dictionary of several thousand phrases."""
    d = table(spark, sf, "documents", "doc_id", "text")
    keys = None
    for words in (r"^[a-z]+ [a-z]+", r"^[a-z]+ [a-z]+ [a-z]+"):
        mine = d.select(F.regexp_extract(F.lower("text"), words, 0).alias("keyword"), F.concat(F.lit("c"), F.col("doc_id") % 3).alias("category"))
        keys = mine if keys is None else keys.unionByName(mine)
    d = d.withColumn("text", F.replace("text", F.lit("der "), F.lit("no ")))
    return V.history_flags(d, "text", durable(keys.where("keyword <> ''").distinct()), keep=["doc_id"])


# --- note files ----------------------------------------------------------------------------------------------------------

NOTES = "doc_id bigint, lang string, text string, source string"


@query("note_records", """
SELECT doc_id, lang, source, md5(coalesce(text, '')) AS digest, length(text) - length(replace(text, chr(10), '')) AS breaks FROM documents""")
def note_records(spark, sf):
    """Documents as CSV files with quoted line breaks, read again by several tasks per file."""
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    d = table(spark, sf, "documents", "doc_id", "lang", "text", "source")
    d.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    notes = read_notes(spark, path, NOTES, split_bytes=1 << 20)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return notes.select("doc_id", "lang", "source", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), breaks.cast("bigint").alias("breaks"))
