"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair,
    decontaminate,
    divergence,
    html_text,
    packing,
    pivot_search,
    quality,
    secret_scan,
    simhash,
    suffix_dedup,
    token_files,
    toxicity,
    warc,
)
from .shipping import ship
from .tokens import word_vocabulary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def documents(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/documents.parquet").select(*(cols or ("doc_id", "text")))


@query("op1_token_files")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.token_index(documents(spark, sf), word_vocabulary())


@query("op2_secrets")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.secrets(documents(spark, sf, "doc_id", "text", "source"))


def _words(text: str) -> str:
    low = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format(text)
    return f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op3_decontamination", f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.s = win.s),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query("op5_packing")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(documents(spark, sf), word_vocabulary())


@query("op6_html_text")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return html_text.extract(spark.read.parquet(f"{sf}/pages.parquet"))


@query("op7_quality")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return quality.apply_rules(documents(spark, sf)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines",
        "n_failed_lines", "lost_chars")


@query("op8_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest""")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return warc.archive_pages(spark.read.parquet(f"{sf}/pages.parquet"))


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf)).drop("spans")


@query("op10_simhash")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf))


@query("op11_divergence", """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY 1, 2 HAVING count(*) >= 30),
c AS (SELECT x.lang, source, x.t, count(*) AS n FROM (SELECT lang, source, unnest(w) AS t FROM d) x JOIN k ON k.lang = x.lang AND k.t = x.t
  GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
n AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
m AS (SELECT lang, sum(total)::HUGEINT AS total FROM n GROUP BY 1),
p AS (SELECT n.lang, n.source, k.t, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (total + 5 * v) AS p
  FROM n JOIN k ON k.lang = n.lang JOIN v ON v.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.t = k.t),
q AS (SELECT k.lang, k.t, 1 + (1000000000::HUGEINT * (coalesce(x.n, 0) + 5)) // (total + 5 * v) AS q FROM k JOIN v ON v.lang = k.lang
  JOIN m ON m.lang = k.lang LEFT JOIN (SELECT lang, t, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2) x ON x.lang = k.lang AND x.t = k.t),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t
  AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b
  ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.t, (p - q)::BIGINT FROM p JOIN q ON q.lang = p.lang AND q.t = p.t WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
WHERE part = 'pair' OR rank <= 50""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf, "lang", "source", "text"))


@query("op12_pivot_search", """
WITH e AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM s) WHERE rank <= 20""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return pivot_search.top_k(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return conversation_repair.repaired_conversations(spark.read.parquet(f"{sf}/conversations.parquet"))
