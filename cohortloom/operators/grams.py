"""Frequent n-grams level by level, as whole numbers.

A gram can be frequent only if both its shorter grams are, the one without its last word and the one without its first.
So words are counted first and rare ones leave; then pairs of neighbouring frequent words are counted, then triples whose two
pairs are frequent. A gram is a number; its text is put together once, in the small table of its level. Occurrences lie in rows
(row, key, pos, word, gram), one per position that ends a frequent gram of the level.

Where only the most frequent grams are wanted, a level also sets a floor: a gram occurs no more often than its parts, so
what occurs less often than the last wanted gram so far can neither be wanted nor be part of a wanted one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..session import durable


def _words(df: DataFrame, text: str, min_len: int, fold: bool) -> DataFrame:
    """``(term, df, cf)`` of all words from one pass: a row adds its words and, apart from them, its distinct words."""
    each = df.select(word_tokens(F.col(text), min_len, fold).alias("tokens"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    entries = F.concat(F.transform("tokens", lambda t: F.struct(t.alias("term"), zero.alias("df"), one.alias("cf"))),
                       F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), one.alias("df"), zero.alias("cf"))))
    return each.select(F.explode_outer(entries).alias("e")).select("e.*").where("term IS NOT NULL").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _occurrences(df: DataFrame, key: str, text: str, words: DataFrame, min_len: int, fold: bool) -> DataFrame:
    """Positions of the words (term, gram) in every row of ``df``, each with the word right before it, if that is one too."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                     word_tokens(F.col(text), min_len, fold).alias("tokens"))
    moved = F.concat(F.array(F.lit(None).cast("string")), F.col("tokens"))
    pairs = F.arrays_zip(F.col("tokens").alias("term"), F.slice(moved, F.lit(1), F.size("tokens")).alias("prior"))
    each = rows.select("row", "key", F.posexplode_outer(pairs).alias("pos", "t")).select("row", "key", "pos", "t.term", "t.prior")
    before = words.select(F.col("term").alias("prior"), F.col("gram").alias("before"))
    return each.join(words.select("term", F.col("gram").alias("word")), "term").join(before, "prior", "left").select(
        "row", "key", "pos", "word", F.col("word").alias("gram"), "before")


def _longer(level: DataFrame) -> DataFrame:
    """Occurrences (row, key, pos, word, before): a gram of the level that ends one position before another."""
    by = Window.partitionBy("row").orderBy("pos")
    return level.select("row", "key", "pos", "word", F.when(F.lag("pos").over(by) == F.col("pos") - 1, F.lag("gram").over(by))
                        .alias("before")).where("before IS NOT NULL")


def _grams(longer: DataFrame, min_df: int, least: int) -> DataFrame:
    """``(before, word, df, cf)`` of the grams with both counts. Occurrences are counted first, by partial sums; only the grams
    that reach ``least`` are then told apart by row."""
    often = durable(longer.groupBy("before", "word").agg(F.count(F.lit(1)).alias("cf")).where(F.col("cf") >= least))
    in_row = longer.join(often.select("before", "word"), ["before", "word"], "left_semi").groupBy("row", "before", "word").agg(
        F.lit(1).alias("one"))
    holders = in_row.groupBy("before", "word").agg(F.count("one").alias("df")).where(F.col("df") >= min_df)
    return holders.join(often, ["before", "word"])


def _floor(tables: list[DataFrame], limit: Column, max_terms: int | None, min_df: int) -> int:
    """Occurrences below which no gram is wanted, given the grams of some levels: those of the last wanted one so far."""
    if not max_terms or not tables:
        return min_df
    every = tables[0].select("df", "cf")
    for t in tables[1:]:
        every = every.unionByName(t.select("df", "cf"))
    last = every.where(F.col("df") <= limit).orderBy(F.desc("cf")).limit(max_terms).agg(
        F.count(F.lit(1)).alias("n"), F.min("cf").alias("least")).first()
    return max(min_df, last["least"]) if last["n"] == max_terms else min_df


def fit_grams(df: DataFrame, key: str, text: str, n_docs: Column | int, lo: int = 1, hi: int = 3, min_df: int = 20,
              max_df: float = 0.95, max_terms: int | None = 2000, min_len: int = 2,
              fold: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(term, df, cf)`` of the n-grams of ``lo`` to ``hi`` words in at least ``min_df`` rows and at most the share ``max_df``
    of them, the ``max_terms`` most frequent ones (ties by term), and their occurrences ``(key, term)`` in the rows.

    Exact: the same terms and counts as from counting every gram. A null text has no words. The words of a row meet the
    frequent ones before anything of a row is shuffled."""
    limit = F.lit(max_df) * (F.lit(n_docs) if isinstance(n_docs, int) else n_docs)
    every_word = durable(_words(df, text, min_len, fold).where(F.col("df") >= min_df))
    least = _floor([every_word] if lo == 1 else [], limit, max_terms, min_df)
    words = durable(every_word.where(F.col("cf") >= least).withColumn("gram", F.monotonically_increasing_id()))
    level = durable(_occurrences(df, key, text, words, min_len, fold))
    spelled = words.select(F.col("gram").alias("word"), F.col("term").alias("last"))
    tables, levels, grams = [words], [level], words
    for n in range(2, hi + 1):
        longer = level.where("before IS NOT NULL") if n == 2 else _longer(level)
        counts = _grams(longer.drop("gram"), min_df, least)
        names = grams.select(F.col("gram").alias("before"), F.col("term").alias("first"))
        grams = durable(counts.join(names, "before").join(spelled, "word").select(
            "before", "word", F.concat_ws(" ", "first", "last").alias("term"), "df", "cf",
            F.monotonically_increasing_id().alias("gram")))
        if n < hi:  # a higher floor leaves fewer grams to build longer ones from
            least = max(least, _floor([*tables, grams][lo - 1:], limit, max_terms, min_df))
            grams = durable(grams.where(F.col("cf") >= least))
        level = durable(longer.drop("gram").join(grams.select("before", "word", "gram"), ["before", "word"]).select(
            "row", "key", "pos", "word", "gram"))
        tables.append(grams)
        levels.append(level)
    sized = [t.select("term", "df", "cf", "gram", F.lit(n).alias("n")) for n, t in enumerate(tables, 1) if n >= lo]
    every = sized[0]
    for t in sized[1:]:
        every = every.unionByName(t)
    kept = every.where(F.col("df") <= limit)
    kept = durable(kept.orderBy(F.desc("cf"), F.asc("term")).limit(max_terms) if max_terms else kept)
    found = None
    for n, rows in enumerate(levels, 1):
        if n >= lo:
            mine = rows.join(kept.where(F.col("n") == n).select("gram", "term"), "gram").select(F.col("key").alias(key), "term")
            found = mine if found is None else found.unionByName(mine)
    return kept.select("term", "df", "cf"), found
