"""Benchmark decontamination with an FM-index per training shard.

A task cuts its documents into shards of about ``shard_words`` words. Words that no benchmark item holds, and document
ends, are separators; each separator is a symbol of its own that sorts by position, so suffixes end there and no match
crosses one. Per shard: suffix array, Burrows-Wheeler transform, a wavelet matrix for ranks, and suffix positions sampled
every ``SAMPLE`` words and behind separators. All benchmark windows go through backward search together, occurrences are
located by walking to a sampled row, and overlapping occurrences merge into removal spans.

The benchmark's windows travel to the tasks in blocks of at most ``block_bytes`` of text; a larger benchmark takes one
pass per block over the same rows, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 32
#: Bytes of UTF-8 text: A-Z folded, everything ASCII but letters and digits to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class BitRank:
    """Ranks of a bit vector from 64-bit words and one count per word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits in front of each position."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """Rank of a symbol in front of a position, one bit level at a time."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels: list[tuple[int, int, BitRank]] = []
        for shift in range(depth - 1, -1, -1):
            bits = ((symbols >> shift) & 1).astype(bool)
            self.levels.append((shift, len(bits) - int(bits.sum()), BitRank(bits)))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        every = np.arange(1 << depth)
        self.begin = self._place(every, np.zeros(len(every), np.int64))

    def _place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, zeros, rank in self.levels:
            ones = rank.ones(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._place(symbol, i) - self.begin[symbol]


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes of ``text``, whose last symbol and all symbols 0 are separators.

    One sort by the first symbols and the position; only suffixes without a separator among these stay tied, and are
    sorted by the ranks further on, at doubled distance each time."""
    n = len(text)
    place = max(1, int(n).bit_length())
    k = max(1, (63 - place) // bits)
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k):
        ahead = np.zeros(n, np.int64)
        ahead[:max(0, n - j)] = text[j:]
        open_ &= ahead > 0
        key = (key << bits) | np.where(open_, ahead, 0)
    order = np.sort((key << place) | np.arange(n))
    sa = order & ((1 << place) - 1)
    value, unfinished = order >> place, open_[order & ((1 << place) - 1)]
    fresh = np.ones(n, bool)
    fresh[1:] = (value[1:] != value[:-1]) | ~unfinished[1:]
    rank = np.zeros(n, np.int64)
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[sa] = head
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    rows, step = np.flatnonzero(tied), k
    while len(rows):
        p = sa[rows]
        pair = rank[p] * (n + 1) + rank[p + step]
        by = np.argsort(pair, kind="stable")
        p, pair = p[by], pair[by]
        sa[rows] = p
        fresh = np.ones(len(rows), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        rank[p] = np.maximum.accumulate(np.where(fresh, rows, 0))
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        rows, step = rows[tied], 2 * step
    return sa


class FMIndex:
    """Exact index of one shard: words as numbers from 1, 0 for separators, the last symbol a separator."""

    def __init__(self, text: np.ndarray, depth: int):
        sa = suffix_array(text, depth)
        self.bwt = text[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << depth))])
        self.ranks = WaveletMatrix(self.bwt, depth)
        self.sampled = (sa % SAMPLE == 0) | (self.bwt == 0)
        self.marks = BitRank(self.sampled)
        self.samples = sa[self.sampled]
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, row behind the last) of those that occur; patterns are right-aligned rows."""
        live = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(1, patterns.shape[1] + 1):
            active = lengths[live] >= j
            symbol = patterns[live, -j]
            low[active] = self.first[symbol[active]] + self.ranks.rank(symbol[active], low[active])
            high[active] = self.first[symbol[active]] + self.ranks.rank(symbol[active], high[active])
            found = low < high
            live, low, high = live[found], low[found], high[found]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        at, steps, todo = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while True:
            todo = todo[~self.sampled[at[todo]]]
            if not len(todo):
                break
            symbol = self.bwt[at[todo]]
            at[todo] = self.first[symbol] + self.ranks.rank(symbol, at[todo])
            steps[todo] += 1
        return self.samples[self.marks.ones(at)] + steps


class Windows:
    """Distinct windows of benchmark items and the items that hold each."""

    def __init__(self, items: Sequence[tuple[str | None, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.names: list[str | None] = []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            self.names.append(name)
            if ids:
                for i in range(max(1, len(ids) - width + 1)):
                    found.setdefault(tuple(ids[i:i + width]), set()).add(len(self.names) - 1)
        self.lengths = np.asarray([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), width), np.int64)
        for row, w in enumerate(found):
            self.patterns[row, width - len(w):] = w
        holders = [sorted(h) for h in found.values()]
        self.holders = np.asarray([i for h in holders for i in h], np.int64)
        self.cuts = np.concatenate([[0], np.cumsum([len(h) for h in holders])]).astype(np.int64)
        self.depth = max(1, int(len(self.vocabulary)).bit_length())


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers start, start + 1, ... of each start."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def search_shard(texts: list[list[bytes]], windows: Windows) -> list[tuple[list[int], list[str]]]:
    """Merged hit spans (start, end, start, end, ...) in words, and names of items, per document of one shard."""
    sizes = np.asarray([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    get = windows.vocabulary.get
    text = np.zeros(int(begin[-1]), np.int32)
    for a, ws in zip(begin.tolist(), texts):
        text[a:a + len(ws)] = np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws))
    none: tuple[list[int], list[str]] = ([], [])
    if not len(windows.lengths) or not text.any():
        return [none] * len(texts)
    index = FMIndex(text, windows.depth)
    which, low, high = index.search(windows.patterns, windows.lengths)
    if not len(which):
        return [none] * len(texts)
    window = np.repeat(which, high - low)
    at = index.locate(_spread(low, high - low))
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + windows.lengths[window], -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8)]))
    opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(begin, at, "right") - 1
    pairs = np.unique(doc * len(windows.lengths) + window)
    doc, window = pairs // len(windows.lengths), pairs % len(windows.lengths)
    count = windows.cuts[window + 1] - windows.cuts[window]
    held = np.unique(np.repeat(doc, count) * len(windows.names) + windows.holders[_spread(windows.cuts[window], count)])
    out: list[tuple[list[int], list[str]]] = [([], []) for _ in texts]
    for a, b, d in zip(opens.tolist(), closes.tolist(), (np.searchsorted(begin, opens, "right") - 1).tolist()):
        out[d][0].extend((a - int(begin[d]), b - int(begin[d])))
    for d, i in zip((held // len(windows.names)).tolist(), (held % len(windows.names)).tolist()):
        if windows.names[i] is not None:
            out[d][1].append(windows.names[i])
    return out


def _merge(spans: Sequence[int]) -> list[int]:
    """Overlapping and touching spans as one."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", shard_words: int = 1 << 20, block_bytes: int = 16 << 20,
                       remove: bool = False) -> DataFrame:
    """``docs`` with n_words, hit_spans (word numbers start, end, start, end, ...; merged) and hit_items (distinct ids as
    strings) appended; a column of ``docs`` with such a name is replaced.

    Null and empty texts have no words. Items without words match nothing; items without id count as hits but are not
    named. An item of fewer than ``width`` words is one window. With ``remove`` the hit words, and what stands between words
    of one span, are taken out of the text. Without items or rows nothing is hit. A document is
    never cut, so a shard is as large as its longest document at least."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t")).where("t <> ''").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    out = docs.drop("n_words", "hit_spans", "hit_items")
    kept = out.columns
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast("array<long>"),
                           "hit_items": F.array().cast("array<string>")})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    position = kept.index(text)

    def scan(windows, cut: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            texts: list[list[bytes]] = []

            def flush() -> pa.RecordBatch:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                found = search_shard(texts, windows.value)
                before = zip(table.column(len(kept) + 1).to_pylist(), table.column(len(kept) + 2).to_pylist())
                spans, names = [], []
                for (s, n), (s0, n0) in zip(found, before):
                    spans.append(_merge([*s0, *s]) if s0 else s)
                    names.append(sorted({*n0, *n}))
                columns = table.columns[:len(kept)]
                if cut and any(spans):
                    columns[position] = pa.array([_cut(t, s) if s else t for t, s in zip(
                        columns[position].to_pylist(), spans)], columns[position].type)
                return pa.record_batch([*columns, pa.array([len(t) for t in texts], pa.int64()),
                                        pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))],
                                       names=table.schema.names)

            size = 0
            for batch in batches:
                done = 0
                for row, value in enumerate(batch.column(position)):
                    texts.append(words_of(value.as_py()))
                    size += len(texts[-1])
                    if size >= shard_words:
                        held.append(batch.slice(done, row + 1 - done))
                        yield flush()
                        held, texts, size, done = [], [], 0, row + 1
                if done < batch.num_rows:
                    held.append(batch.slice(done))
            if texts:
                yield flush()
        return run

    for block in range(max(1, blocks)):
        mine = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(max(1, blocks))) == block).collect()
        windows = spark.sparkContext.broadcast(Windows([(r["id"], r["t"]) for r in sorted(mine, key=str)], width))
        out = out.mapInArrow(scan(windows, remove and block == max(1, blocks) - 1), schema)
    return out


def _cut(text: str, spans: Sequence[int]) -> str:
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    out, done = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[done:at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate(F.transform("hit_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"),
                      lambda s, x: s + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256).alias("items_sha256"),
                        (F.size("hit_spans") > 0).alias("contaminated"))
