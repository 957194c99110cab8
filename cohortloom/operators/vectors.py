"""Sparse text vectors as long tables ``(key, term, weight)``: vocabulary, TF-IDF, centroids, cosine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import l2_normalize
from ..functions.text import ngrams, word_tokens
from ..session import durable


def gram_arrays(df: DataFrame, key: str, text: str, lo: int = 1, hi: int = 3, min_len: int = 2,
                fold: bool = True) -> DataFrame:
    """``(key, grams)``: all n-grams of a row, still one row per text."""
    return df.select(key, word_tokens(F.col(text), min_len, fold).alias("__tokens")) \
        .select(key, ngrams(F.col("__tokens"), lo, hi).alias("grams"))


def _unroll(grams: DataFrame, key: str) -> DataFrame:
    """``(key, term)`` per occurrence. The outer form is used because plain ``explode`` makes the planner
    derive a size filter and push it below the gram projection, which would build the grams twice and
    tokenise the text once per gram."""
    return grams.select(key, F.explode_outer("grams").alias("term")).filter(F.col("term").isNotNull())


def term_counts(grams: DataFrame, key: str) -> DataFrame:
    """``(key, term, tf)``; counting starts on the map side, before the shuffle."""
    return _unroll(grams, key).groupBy(key, "term").agg(F.count("*").alias("tf"))


def gram_totals(df: DataFrame, key: str, text: str, lo: int = 1, hi: int = 3, min_len: int = 2, fold: bool = True) -> DataFrame:
    """``(key, n_terms, n_grams, top_tf)``: distinct n-grams, all of them and the count of the most frequent one per key
    with any.

    The grams of a key with one row are sorted and counted in that row and never shuffled; only those of keys with
    several rows go through ``term_counts``."""
    often = durable(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col(key).alias("__often")))
    same = df[key].eqNullSafe(often["__often"])
    alone = gram_arrays(df.join(often, same, "left_anti"), key, text, lo, hi, min_len, fold)
    start = F.expr("named_struct('last', CAST(NULL AS STRING), 'run', 0L, 'top_tf', 0L, 'n_terms', 0L, 'n_grams', 0L)")

    def step(seen: Column, gram: Column) -> Column:
        again = gram.eqNullSafe(seen["last"])
        run = F.when(again, seen["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct(gram.alias("last"), run.alias("run"), F.greatest(seen["top_tf"], run).alias("top_tf"),
                        F.when(again, seen["n_terms"]).otherwise(seen["n_terms"] + 1).alias("n_terms"),
                        (seen["n_grams"] + 1).alias("n_grams"))

    # an outer generator keeps the filter above it: pushed down, it would tokenise the text once per gram
    counted = F.explode_outer(F.array(F.aggregate(F.sort_array("grams"), start, step)))
    inside = alone.select(key, counted.alias("t")).where("t.n_terms > 0").select(key, "t.n_terms", "t.n_grams", "t.top_tf")
    across = term_counts(gram_arrays(df.join(often, same, "left_semi"), key, text, lo, hi, min_len, fold), key)
    return inside.unionByName(across.groupBy(key).agg(
        F.count("*").alias("n_terms"), F.sum("tf").alias("n_grams"), F.max("tf").alias("top_tf")))


def fit_vocabulary(grams: DataFrame, n_docs: Column | int, min_df: int = 20, max_df: float = 0.95,
                   max_terms: int | None = 2000) -> DataFrame:
    """Terms in at least ``min_df`` rows and at most the share ``max_df`` of rows, the ``max_terms``
    most frequent ones (ties by term): ``(term, df, cf)``.

    A row adds its occurrences and, separately, its distinct terms, so both counts come from one pass
    that shuffles per-term partial sums only, never the grams of a row."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    entries = F.concat(
        F.transform("grams", lambda g: F.struct(g.alias("term"), zero.alias("df"), one.alias("cf"))),
        F.transform(F.array_distinct("grams"), lambda g: F.struct(g.alias("term"), one.alias("df"), zero.alias("cf"))))
    stats = grams.select(F.explode_outer(entries).alias("e")).select("e.*").filter("term IS NOT NULL").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    limit = F.lit(max_df) * (F.lit(n_docs) if isinstance(n_docs, int) else n_docs)
    kept = stats.filter((F.col("df") >= min_df) & (F.col("df") <= limit))
    return kept.orderBy(F.desc("cf"), F.asc("term")).limit(max_terms) if max_terms else kept


def fit_tfidf(vocabulary: DataFrame, n_docs: Column | int) -> DataFrame:
    """Model table ``(term, idf)`` with smoothed ``ln((1 + n) / (1 + df)) + 1``."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return vocabulary.select("term", (F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def apply_tfidf(grams: DataFrame, model: DataFrame, key: str, sublinear: bool = True) -> DataFrame:
    """L2-normalised weights ``(key, term, w)``; terms outside the model are ignored.

    Grams meet the model before they are counted, so only vocabulary terms are shuffled. The model has
    at most the fitted number of terms and the planner can broadcast it by that size."""
    return weigh(_unroll(grams, key), model, key, sublinear)


def weigh(occurrences: DataFrame, model: DataFrame, key: str, sublinear: bool = True) -> DataFrame:
    """L2-normalised weights ``(key, term, w)`` of occurrences ``(key, term)``, such as ``grams.fit_grams`` finds them."""
    hits = occurrences.join(model, "term")
    counts = hits.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("idf").alias("idf"))
    tf = F.log("tf") + 1.0 if sublinear else F.col("tf").cast("double")
    return l2_rows(counts.select(key, "term", (tf * F.col("idf")).alias("w")), [key])


def l2_rows(weights: DataFrame, key: Sequence[str]) -> DataFrame:
    """Scale each key's weights to length 1. A key's terms are bounded by its text or the vocabulary."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*key)))
    return weights.withColumn("w", F.col("w") / norm)


def title_tfidf(df: DataFrame, title: str) -> DataFrame:
    """Vectors of the distinct titles: words and word pairs, one-letter words kept, plain tf."""
    titles = df.select(title).filter(F.col(title).isNotNull()).distinct()
    grams = gram_arrays(titles, title, title, 1, 2, min_len=1, fold=False)
    n = titles.agg(F.count("*")).scalar()
    model = fit_tfidf(fit_vocabulary(grams, n, min_df=1, max_df=1.0, max_terms=None), n)
    return apply_tfidf(grams, model, title, sublinear=False)


def pair_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                name: str = "sim") -> DataFrame:
    """Cosine of given pairs of L2 vectors: term overlap is summed, no overlap gives 0. Only the given
    pairs are scored."""
    keys = pairs.select(left_key, right_key).distinct()
    dots = (keys.join(left.select(F.col(left.columns[0]).alias(left_key), "term", F.col("w").alias("__a")), left_key)
            .join(right.select(F.col(right.columns[0]).alias(right_key), "term", F.col("w").alias("__b")),
                  [right_key, "term"])
            .groupBy(left_key, right_key).agg(F.sum(F.col("__a") * F.col("__b")).alias("__dot")))
    return pairs.join(dots, [left_key, right_key], "left") \
        .withColumn(name, F.coalesce(F.col("__dot"), F.lit(0.0))).drop("__dot")


def lookup_vectors(df: DataFrame, key: str, store: DataFrame, vector: str, dim: int) -> DataFrame:
    """Stored vector per key, scaled to length 1; a missing one is the zero vector."""
    zero = F.array_repeat(F.lit(0.0), dim)
    found = df.join(store.select(key, F.col(vector).cast("array<double>").alias("__vec")), key, "left")
    return found.withColumn(vector, l2_normalize(F.coalesce("__vec", zero))).drop("__vec")


def missing_titles(df: DataFrame, title: str, store: DataFrame) -> DataFrame:
    """Distinct titles without a stored vector."""
    return df.select(title).filter(F.col(title).isNotNull()).distinct().join(store.select(title), title, "left_anti")
