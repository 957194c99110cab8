"""Phrase dictionaries of any size: runs of tokens looked up in a table of phrases.

A text is cut into tokens once, each a word with what stands in front of it. A run that begins at a word may be a phrase only if all its
beginnings begin a phrase. A filter of hashed beginnings and ends of all phrases, of 32 MB at most, goes to the tasks and shows inside the
row which runs may be phrases; the distinct ones of a text are all that is shuffled. They meet the phrases in a hash join, so what the
filter lets through by chance is dropped. For flags, a bounded number of phrases with many categories goes to the tasks too: a row that
holds all categories by these sends nothing, any other row the runs that are none of them. No other phrase passes through the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: A word and all that is no word in front of it.
TOKEN = r"(?U)\W*\w+"
WORD = r"(?U)\w+"
#: Bits of the filter: a power of two, 16 for each beginning and end as long as that stays below the most (32 MB).
LEAST_BITS, MOST_BITS, BITS_EACH = 15, 28, 16
#: Tokens that are walked over at once.
PORTION = 1 << 18
#: Phrases that go to the tasks as they are, and the most characters of one.
COMMON, COMMON_LENGTH = 1 << 16, 64


def _extract(col: Column, pattern: str) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def _hashes(col: Column, pattern: str) -> Column:
    return F.transform(_extract(col, pattern), lambda t: F.hash(t))


def phrase_table(table: DataFrame, keyword: str = "keyword", category: str = "category") -> DataFrame:
    """``(phrase, level, categories)`` of a keyword table, stored: each phrase with and without a plural s and its number of
    tokens. Phrases begin and end with a word character, others match nothing; those without keyword or category are skipped."""
    text = F.lower(F.trim(F.col(keyword)))
    rows = table.select(text.alias("phrase"), F.col(category).alias("category")).where(
        F.col("phrase").rlike(r"(?Us)^\w(.*\w)?$") & F.col("category").isNotNull())
    both = rows.select(F.explode(F.array("phrase", F.concat("phrase", F.lit("s")))).alias("phrase"), "category")
    return durable(both.groupBy("phrase").agg(F.collect_set("category").alias("categories"))
                   .select("phrase", F.size(_extract(F.col("phrase"), TOKEN)).alias("level"), "categories"))


def _walkers(bits: int, deepest: int, sent: Broadcast | None = None) -> tuple[Callable[..., Column], Callable[..., Column]]:
    """Functions of the hashed words and hashed tokens of a row: the places in the filter of a phrase's beginnings and of its end, and the
    runs ``(at, n)`` of a text, from token ``at`` on and ``n`` tokens long, that the filter ``sent`` takes for phrases."""
    whole = np.uint64

    def grown(h, token):
        h = (h ^ token.astype(np.uint64)) * whole(0x9E3779B97F4A7C15)
        return h ^ (h >> whole(32))

    def ended(h):
        return grown(h ^ whole(0x5BD1E9955BD1E995), h >> whole(7))

    def places(h):
        return h & whole((1 << bits) - 1), (h * whole(0xC2B2AE3D27D4EB4F)) >> whole(64 - bits)

    def passed(h, bitmap):
        first, second = places(h)
        here = (bitmap[first >> whole(3)] >> (first & whole(7)).astype(np.uint8)) & 1 == 1
        more = second[here]
        here[here] = (bitmap[more >> whole(3)] >> (more & whole(7)).astype(np.uint8)) & 1 == 1
        return here

    def flat(column):
        return column.flatten().to_numpy(zero_copy_only=False).view(np.uint32)

    def starts_of(column):
        return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])

    def phrase_places(words: pa.Array, tokens: pa.Array) -> pa.Array:
        word, token, starts = flat(words), flat(tokens), starts_of(words)
        row, at = np.arange(len(starts) - 1), starts[:-1]
        h, n, rows, found = grown(np.zeros(len(at), np.uint64), word[at]), 1, [], []
        while len(row):
            last = at + n == starts[row + 1]
            for where, which in ((row, h), (row[last], ended(h[last]))):
                for place in places(which):
                    rows.append(where)
                    found.append(place.astype(np.int64))
            row, at = row[~last], at[~last]
            h, n = grown(h[~last], token[at + n]), n + 1
        rows = np.concatenate([np.zeros(0, np.int64), *rows])
        order = np.argsort(rows, kind="stable")
        return pa.ListArray.from_arrays(np.searchsorted(rows[order], np.arange(len(starts))).astype(np.int32),
                                        np.concatenate([np.zeros(0, np.int64), *found])[order])

    def runs_of(word, token, ends, bitmap):
        at, n, ats, sizes = np.arange(len(word)), 1, [], []
        h = grown(np.zeros(len(at), np.uint64), word)
        while len(at) and n <= deepest:
            here = passed(h, bitmap)
            at, h = at[here], h[here]
            mine = at[passed(ended(h), bitmap)]
            ats.append(mine)
            sizes.append(np.full(len(mine), n, np.int32))
            goes_on = at + n < ends[at]
            at = at[goes_on]
            h, n = grown(h[goes_on], token[at + n]), n + 1
        ats, sizes = np.concatenate([np.zeros(0, np.int64), *ats]), np.concatenate([np.zeros(0, np.int32), *sizes])
        order = np.argsort(ats, kind="stable")
        return ats[order], sizes[order]

    def text_runs(words: pa.Array, tokens: pa.Array) -> pa.Array:
        bitmap, word, token, starts = sent.value, flat(words), flat(tokens), starts_of(words)
        begins, ats, sizes, counts, lo = starts[:-1], [], [], [], 0
        while lo < len(begins):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + PORTION, "right")) - 1)
            cut, mine = slice(starts[lo], starts[hi]), starts[lo:hi + 1] - starts[lo]
            at, n = runs_of(word[cut], token[cut], np.repeat(mine[1:], np.diff(mine)), bitmap)
            bounds = np.searchsorted(at, mine)
            counts.append(np.diff(bounds))
            ats.append((at - np.repeat(mine[:-1], counts[-1])).astype(np.int32))
            sizes.append(n)
            lo = hi
        runs = pa.StructArray.from_arrays([np.concatenate([np.zeros(0, np.int32), *x]) for x in (ats, sizes)], names=["at", "n"])
        return pa.ListArray.from_arrays(np.cumsum(np.concatenate([[0], *counts]), dtype=np.int32), runs)

    return F.arrow_udf(phrase_places, "array<bigint>"), F.arrow_udf(text_runs, "array<struct<at:int,n:int>>")


def phrase_runs(df: DataFrame, text: Column, phrases: DataFrame, name: str = "runs") -> DataFrame:
    """``df`` with the distinct runs of tokens of ``text`` that may be one of ``phrases`` (of ``phrase_table``), an array of strings; no
    phrase is missing, and few others are in it. A null text has none."""
    deepest, keys = phrases.agg(F.max("level"), F.sum(F.col("level") + 1)).first()
    bits = min(max((BITS_EACH * (keys or 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    places, _ = _walkers(bits, deepest or 0)
    place = phrases.select(F.explode(places(_hashes(F.col("phrase"), WORD), _hashes(F.col("phrase"), TOKEN))).alias("place"))
    # a row of the bitmap has 32,768 bits
    filled = place.groupBy(F.shiftright("place", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("bits"))
    bitmap = np.zeros((1 << bits - 15, 4096), np.uint8)
    for part, row in filled.collect():
        bitmap[part] = np.frombuffer(row, np.uint8)
    _, runs = _walkers(bits, deepest or 0, df.sparkSession.sparkContext.broadcast(bitmap.reshape(-1)))
    text = F.coalesce(text, F.lit(""))
    # a text has as many words as tokens
    cut = df.withColumns({"__tokens": _extract(text, TOKEN), "__words": _hashes(text, WORD)})
    found = cut.withColumn(name, runs("__words", F.transform("__tokens", lambda t: F.hash(t))))
    word = lambda r: F.regexp_extract(F.element_at("__tokens", r["at"] + 1), WORD + "$", 0)
    return found.withColumn(name, F.array_distinct(F.transform(name, lambda r: F.concat(
        word(r), F.array_join(F.slice("__tokens", r["at"] + 2, r["n"] - 1), ""))))).drop("__tokens", "__words")


def _common(phrases: DataFrame) -> DataFrame:
    """At most ``COMMON`` of the phrases: those of most categories and among them the shortest, as these settle most rows. Counts tell
    where to end; phrases of the same number of categories and the same length come all or none."""
    kind = {"n": F.size("categories"), "length": F.length("phrase")}
    short = phrases.withColumns(kind).where(F.col("length") <= COMMON_LENGTH)
    total, last = 0, None
    for n, length, count in sorted(short.groupBy("n", "length").count().collect(), key=lambda r: (-r[0], r[1])):
        total += count
        if total > COMMON:
            break
        last = (n, length)
    return short.where(F.lit(False) if last is None else (F.col("n") > last[0]) | ((F.col("n") == last[0]) & (F.col("length") <= last[1])))


def _settler(sent: Broadcast, n_categories: int) -> Callable[..., Column]:
    """Function of the runs of a row: the numbers of the categories that common phrases give it, and the runs that are no common
    phrase, none if the row has all categories."""
    full = np.packbits(np.ones(n_categories, np.uint8))

    def settle(runs: pa.Array) -> pa.Array:
        phrases, masks = sent.value
        sizes, flat = runs.value_lengths().to_numpy(zero_copy_only=False), runs.flatten()
        row = np.repeat(np.arange(len(runs)), sizes)
        at = pc.fill_null(pc.index_in(flat, value_set=phrases.cast(flat.type)), -1).to_numpy(zero_copy_only=False)
        known = at >= 0
        seen = np.zeros((len(runs), len(full)), np.uint8)
        if known.any():
            starts = np.flatnonzero(np.diff(row[known], prepend=-1))
            seen[row[known][starts]] = np.bitwise_or.reduceat(masks[at[known]], starts, axis=0)
        rest = np.flatnonzero(~known & (seen != full).any(axis=1)[row])
        has, found = np.nonzero(np.unpackbits(seen, axis=1, count=n_categories))
        bounds = lambda rows: np.searchsorted(rows, np.arange(len(runs) + 1)).astype(np.int32)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(bounds(has), found.astype(np.int32)),
                                           pa.ListArray.from_arrays(bounds(row[rest]), flat.take(pa.array(rest)))], names=["found", "rest"])

    return F.arrow_udf(settle, "struct<found:array<int>,rest:array<string>>")


def settle_common(df: DataFrame, runs: str, phrases: DataFrame, categories: Sequence, found: str, rest: str) -> DataFrame:
    """``df`` with its ``runs`` replaced by ``found``, numbers of ``categories`` that common phrases give the row, and ``rest``, the runs
    that have still to meet ``phrases``. A row that has all categories has no rest."""
    number = {c: i for i, c in enumerate(categories)}
    common = _common(phrases).select("phrase", "categories").collect()
    masks = np.zeros((len(common), len(categories)), np.uint8)
    for i, (_, mine) in enumerate(common):
        masks[i, [number[c] for c in mine]] = 1
    sent = df.sparkSession.sparkContext.broadcast((pa.array([r[0] for r in common], pa.string()), np.packbits(masks, axis=1)))
    return df.withColumn(runs, _settler(sent, len(categories))(runs)).withColumns({
        found: F.col(f"{runs}.found"), rest: F.col(f"{runs}.rest")}).drop(runs)


def phrase_hits(df: DataFrame, key: str, text: Column, table: DataFrame, keyword: str = "keyword",
                category: str = "category") -> DataFrame:
    """Distinct ``(key, category)``: rows of ``df`` whose ``text`` holds a phrase of the table as whole words, a plural s allowed.
    A null text holds nothing. Only runs of tokens that may be phrases are shuffled."""
    phrases = phrase_table(table, keyword, category)
    found = phrase_runs(df.select(F.col(key), text.alias("text")), F.col("text"), phrases).select(key, F.explode("runs").alias("phrase"))
    return found.join(phrases, "phrase").select(key, F.explode("categories").alias("category")).distinct()
