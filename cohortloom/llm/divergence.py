"""Term statistics of sources by sorting pointers to word starts.

A task gathers documents into shards of about ``shard_bytes`` of text and keeps the text in one Arrow buffer. Word starts are
pointers into it; the pointers of one (lang, source) group are a slice, ordered by multikey quicksort on eight bytes at a
time: keys below, equal to and above a pivot, the equal ones going on eight bytes further. Each run of equal words is then
one row with its number of occurrences and of documents. Only these rows are shuffled; a word is cut out of the buffer
once per run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

#: A-Z folded, ASCII without letters to 0, all else as it is.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 0 for b in range(256)], np.uint8)
#: Keeps the first n of eight bytes of a big-endian key.
KEEP = np.array([0] + [(0xFFFFFFFFFFFFFFFF << (64 - 8 * n)) & 0xFFFFFFFFFFFFFFFF for n in range(1, 9)], np.uint64)
SMALL = 1 << 14  # slices of at most so many pointers are ordered by one sort of their keys
SCALE = 1_000_000_000
SMOOTH = 5
CELLS = 1 << 16  # of a block of terms and sources
RUNS = "lang string, source string, term string, n long, df long"


class Words:
    """Pointers to the words of one shard; ``data`` has a zero behind every document."""

    def __init__(self, texts: pa.Array):
        sizes = np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.data = np.zeros(int(first[-1]) + 8, np.uint8)
        inside = np.ones(int(first[-1]), bool)
        inside[first[1:] - 1] = False
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset:]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        self.data[:len(inside)][inside] = FOLD[raw]
        edge = np.diff((self.data[:len(inside)] > 0).view(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.size = np.flatnonzero(edge == -1) - self.start
        self.doc = np.searchsorted(first, self.start, "right") - 1
        self.eight = np.lib.stride_tricks.as_strided(self.data, (max(1, len(self.data) - 7), 8), (1, 1))

    def keys(self, words: np.ndarray, depth: int) -> np.ndarray:
        """Bytes ``depth`` to ``depth + 8`` of words as numbers that sort like them; zero behind the end."""
        rest = np.clip(self.size[words] - depth, 0, 8)
        at = np.minimum(self.start[words] + depth, len(self.eight) - 1)
        return self.eight[at].view(">u8")[:, 0].astype(np.uint64) & KEEP[rest]

    def spelled(self, words: np.ndarray) -> pa.Array:
        sizes = self.size[words]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.start[words] - cuts[:-1], sizes) + np.arange(int(cuts[-1]))
        return pa.StringArray.from_buffers(len(words), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(self.data[at]))


def _leaf(words: Words, mine: np.ndarray, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A small slice in order and where its runs begin: sorted by the keys, then tied words by eight bytes more at a time."""
    by = np.argsort(keys, kind="stable")
    mine, keys = mine[by], keys[by]
    first = np.ones(len(mine), bool)
    first[1:] = keys[1:] != keys[:-1]
    open_ = (keys & np.uint64(0xFF)) != 0
    while True:
        tied = ~first
        tied[:-1] |= ~first[1:]
        rows = np.flatnonzero(tied & open_)
        if not len(rows):
            return mine, np.flatnonzero(first)
        depth += 8
        run = np.cumsum(first)[rows]
        keys = words.keys(mine[rows], depth)
        by = np.lexsort((keys, run))
        mine[rows], keys = mine[rows[by]], keys[by]
        first[rows[1:]] |= keys[1:] != keys[:-1]
        open_[:] = False
        open_[rows] = (keys & np.uint64(0xFF)) != 0


def equal_runs(words: Words, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``members`` (word numbers) in the order of their words, and where runs of equal words begin in it.

    Multikey quicksort with a stack; the order of equal words is kept."""
    out, starts = np.empty_like(members), []
    stack = [(0, members, words.keys(members, 0), 0)]  # place in out, words, their keys, bytes that they share
    while stack:
        place, mine, keys, depth = stack.pop()
        if len(mine) <= SMALL:
            out[place:place + len(mine)], begin = _leaf(words, mine, keys, depth)
            starts.append(place + begin)
            continue
        some = np.sort(keys[::len(keys) // 31])
        pivot = some[len(some) // 2]
        low, high = keys < pivot, keys > pivot
        below, above = mine[low], mine[high]
        equal = mine[~(low | high)]
        middle = place + len(below)
        if len(below):
            stack.append((place, below, keys[low], depth))
        if len(above):
            stack.append((middle + len(equal), above, keys[high], depth))
        if int(pivot) & 0xFF:
            stack.append((middle, equal, words.keys(equal, depth + 8), depth + 8))
        else:
            out[middle:middle + len(equal)] = equal
            starts.append(np.array([middle]))
    return out, np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)


def shard_runs(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, n, df) of one shard: occurrences and documents of each word per group."""
    words = Words(texts)
    names = sources.dictionary_encode()
    pair = np.asarray(langs.dictionary_encode().indices, np.int64) * len(names.dictionary) + np.asarray(names.indices)
    some, pair = np.unique(pair, return_index=True, return_inverse=True)[1:]  # a document of each group
    group = pair[words.doc]
    by = np.argsort(group, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(some)))])
    order, begin = [by[:0]], [np.zeros(0, np.int64)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b > a:
            mine, starts = equal_runs(words, by[a:b])
            order.append(mine)
            begin.append(a + starts)
    order, begin = np.concatenate(order), np.concatenate(begin)
    n = np.diff(np.append(begin, len(order)))
    doc = words.doc[order]
    new = np.ones(len(order), np.int64)
    new[1:] = doc[1:] != doc[:-1]
    new[begin] = 1
    df = np.add.reduceat(new, begin) if len(begin) else n
    head = order[begin]
    doc = pa.array(some[group[head]])
    return pa.record_batch([langs.take(doc), sources.take(doc), words.spelled(head), pa.array(n), pa.array(df)],
                           names=["lang", "source", "term", "n", "df"])


def _shards(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return shard_runs(*(c.chunk(0).cast(pa.string()) for c in table.columns))

        for batch in batches:
            done = 0
            ends = np.cumsum(np.asarray(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False), np.int64))
            while done < batch.num_rows:
                before = int(ends[done - 1]) if done else 0
                row = int(np.searchsorted(ends, before + max(1, shard_bytes - size)))
                if row >= batch.num_rows:
                    held.append(batch.slice(done))
                    size += int(ends[-1]) - before
                    break
                held.append(batch.slice(done, row + 1 - done))
                yield flush()
                held, size, done = [], 0, row + 1
        if held:
            yield flush()
    return run


def term_counts(docs: DataFrame, shard_bytes: int = 24 << 20) -> DataFrame:
    """(lang, source, term, n, df): occurrences of every term in every group of ``docs`` (lang, source, text), and the
    number of its documents that hold the term.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Nulls are read as ''; texts without terms
    give no row; a document is never cut, so a shard is as large as its longest document at least. Other columns are ignored."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(_shards(shard_bytes), RUNS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)) as a long, by decimal arithmetic."""
    def wide(c: Column) -> Column:
        return c.cast("decimal(19,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * wide(n + SMOOTH)
    return F.lit(1).cast("long") + F.call_function("div", top, wide(total + SMOOTH * terms))


def _distances(lang: str, sources: list, p: np.ndarray) -> Iterator[dict]:
    for i, name in enumerate(sources):
        yield {"lang": lang, "source": name, "item": sources,
               "value": np.abs(p - p[:, i:i + 1]).sum(axis=0, dtype=np.int64)}


def _block(pdf):
    """Sums of |p - q| over the terms of one block, for all ordered pairs of sources."""
    import pandas as pd
    lang = pdf["lang"].iloc[0]
    empty = pdf["term"] == ""
    base = pdf[empty].sort_values("source")
    sources = base["source"].tolist()
    at = {s: i for i, s in enumerate(sources)}
    rows = pdf[~empty]
    codes, terms = pd.factorize(rows["term"])
    p = np.tile(base["p"].to_numpy(np.int64), (len(terms), 1))
    p[codes, rows["source"].map(at).to_numpy(np.int64)] = rows["p"].to_numpy(np.int64)
    parts = [pd.DataFrame(x) for x in _distances(lang, sources, p)]
    out = pd.concat(parts)
    return out[out["source"] != out["item"]]


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) over ``docs`` (lang, source, text).

    A language keeps the terms in at least ``least_docs`` of its documents. Part 'pair': for each (lang, source) group every
    other source of the language with the sum over all kept terms of the difference of their smoothed shares, 0 where the
    language keeps none. Part 'term': the group's terms of a higher share than in the language, the ``top`` highest
    differences. Ranks go by value descending, then item ascending in UTF-8 order. Nulls are read as ''; an empty table
    gives no rows; repeated rows count as documents of their own; other columns are ignored. One row per (group, term)
    is shuffled; a term or source of many rows is only a hot key of sums and of joins that adaptive execution splits. The pairs
    of a language come from blocks of ``CELLS`` terms times sources, whatever the number of either."""
    docs = docs.select("lang", "source", "text")
    counts = term_counts(docs)
    kept_terms = counts.groupBy("lang", "term").agg(F.sum("df").alias("docs"), F.sum("n").alias("n_lang")).where(
        F.col("docs") >= least_docs)
    # With all columns of the counts on either side, both read one shuffle of them.
    kept = durable(counts.join(kept_terms, ["lang", "term"]).select("lang", "source", "term", "n", "df", "n_lang"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = kept.select("lang", "term", "n_lang").distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("total_lang"))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    totals = durable(groups.join(own, ["lang", "source"], "left").join(by_lang, "lang", "left").join(sizes, "lang")
                     .na.fill(0, ["total", "terms", "total_lang"]))
    shares = durable(
        kept.join(totals, ["lang", "source"])
        .select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
                share(F.col("n_lang"), F.col("total_lang"), F.col("terms")).alias("q"), "terms", "sources"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    term = (shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))

    blocks = F.ceil(F.col("terms") * F.col("sources") / CELLS)
    filled = shares.select("lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), "source", "term", "p")
    bare = (totals.where("terms > 0")
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            .select("lang", "block", "source", F.lit("").alias("term"),
                    share(F.lit(0).cast("long"), F.col("total"), F.col("terms")).alias("p")))
    sums = (filled.unionByName(bare).groupBy("lang", "block")
            .applyInPandas(_block, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    none = totals.where("terms = 0").select("lang", "source")
    zero = none.join(none.withColumnRenamed("source", "item"), "lang").where("source <> item").select(
        "lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pair = sums.unionByName(zero).withColumn("rank", F.row_number().over(ranked))
    columns = ["lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"]
    return pair.select(*columns).unionByName(
        term.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
