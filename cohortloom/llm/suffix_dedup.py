"""Removal of byte strings that occur earlier, by two-stage suffix sorting of neighbourhoods.

Every ``length``-byte string contains the first seed (``SEED`` bytes) among its seeds, by an order of their bytes alone (by
hash, those that a sample shows to be common last); equal strings share it at the same place. So neighbourhoods of such
anchors, just as wide as the strings they are the first seed of, hold every repeat. As rare seeds come first, those of a
common passage end where the passage does, and are equal in most places:

1. Anchors with the hash of their whole neighbourhood meet by seed. Of equal neighbourhoods all but the earliest are
   repeats from end to end. Seeds with one neighbourhood are done.
2. The earliest of each different neighbourhood of a seed are fetched. Those that share no window of a little less than
   ``length`` bytes around the seed are let go, the rest is suffix-sorted in chunks: suffixes smaller than
   their successor are sorted directly, all others are induced by scanning the buckets of first bytes, and neighbours
   in the order with a common prefix of ``length`` bytes form runs whose earliest member stays.
3. Spans are merged per document and taken out.

A seed with more neighbourhoods than a chunk holds (a common line, say) is keyed by those windows instead of itself. A
window that still does not fit a chunk is keyed by the hashes of its exact strings, which are aggregated to their earliest
place and joined back. So no group is held: of one seed at most a chunk of neighbourhoods, and the seeds that a sample
shows to be the most common are dealt by neighbourhood from the start."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

SEED = 32
#: Positions of one chunk; ranks of its eight-byte words fit in 21 bits, three to a key.
CHUNK = 1 << 21
PARTS = 4
#: Rows that are judged together.
HELD = 1 << 18
#: One row in so many is looked at for common seeds, and those found so often there, the most common first, are dealt by
#: neighbourhood. This only places rows; results do not depend on it.
SAMPLE, OFTEN, COMMON = 32, 32, 4096
#: The same of the seeds at all places, which only order the seeds: in one row in so many, so often, and so many of them.
FEW, SEEN, DEMOTED = 64, 4, 1 << 17
M = np.uint64(0x9E3779B97F4A7C15)
M_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
VALUES = np.random.default_rng(11).integers(1, 1 << 62, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOUND = "kind int, h long, c long, doc long, tie long, pos int, stop int"
JUDGED = FOUND + ", start int"
CONTEXTS = "key long, doc long, tie long, start int, seed int, context binary"
WINDOWED = CONTEXTS + ", part int"
STRINGS = "one long, two long, doc long, tie long, pos int"
SPANS = "doc long, tie long, pos int, stop int"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of the multiplier and of its inverse, as far as the longest text needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 1 << 17)
            for name, by in (("up", M), ("down", M_INVERSE)):
                steps = np.full(n, by, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))


def substring_hash(text: np.ndarray, start: np.ndarray, stop: np.ndarray, family: int = 0) -> np.ndarray:
    """Hash of text[start:stop] for every pair; equal for equal bytes wherever they stand."""
    _Powers.reach(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(VALUES[family][text] * _Powers.up[:len(text)], out=total[1:])
    return _mix((total[stop] - total[start]) * _Powers.down[start] + (stop - start).astype(np.uint64))


def seed_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the ``SEED`` bytes from each position on."""
    h, m = text.astype(np.uint64) + np.uint64(1), int(M)
    for step in (1, 2, 4, 8, 16):
        h = _mix(h[:-step] * np.uint64(m) + h[step:])
        m = (m * m + 2) % (1 << 64)
    return h


def demotion(often: np.ndarray) -> np.ndarray | None:
    """Whether seeds with these first 20 bits of their hash come last, for the hashes that occur ``often``."""
    if not len(often):
        return None
    last = np.zeros(1 << 20, np.uint64)
    last[often.view(np.uint64) >> np.uint64(44)] = np.uint64(1 << 63)
    return last


def anchors(text: np.ndarray, length: int, last: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Positions and seed hashes of the anchors of all ``length``-byte strings, ties are all taken, and the first and last
    start of the strings of each. The order of the seeds is their bytes' alone, so that equal strings have equal anchors;
    those that ``last`` marks follow all others."""
    window = length - SEED + 1
    if len(text) < length:
        return (np.zeros(0, np.int64),) * 4
    h = seed_hashes(text)
    rank = h if last is None else (h >> np.uint64(1)) | last[h >> np.uint64(44)]

    def slide(x: np.ndarray, best) -> np.ndarray:
        width = 1
        while 2 * width <= window:
            x, width = best(x[:-width], x[width:]), 2 * width
        return best(x[:len(x) - (window - width)], x[window - width:]) if width < window else x

    least = slide(rank, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    at = np.flatnonzero(slide(np.concatenate([edge, least, edge]), np.maximum) == rank)
    # of the strings that hold an anchor whole, those it is the least seed of start in one run of equal least seeds
    runs = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(runs[1:], len(least)) - 1
    begin, own = np.maximum(at - window + 1, 0), rank[at]
    run = np.searchsorted(runs, begin, side="right") - 1
    while len(off := np.flatnonzero(least[runs[run]] != own)):
        run[off] += 1
    return at, h[at].view(np.int64), np.maximum(begin, runs[run]), np.minimum(at, ends[run])


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _seeds(length: int, often: np.ndarray | None):
    """Hashes of the anchors, or with no ``often`` of all seeds, and how often a batch holds each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None if often is None else demotion(often)
        for batch in batches:
            texts = [raw for raw in map(_bytes, batch.column(0).to_pylist()) if len(raw) >= length]
            if texts:
                h, n = np.unique(np.concatenate([
                    seed_hashes(raw).view(np.int64) if often is None else anchors(raw, length, last)[1] for raw in texts]), return_counts=True)
                yield pa.record_batch([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])
    return run


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def common_seeds(rows: DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the seeds that samples of ``rows`` (doc, tie, text) hold most often, in order: of seeds at all places, and
    of anchors once the former come last."""
    def most(share: int, times: int, number: int, often: np.ndarray | None) -> np.ndarray:
        sample = rows.where(F.pmod(F.xxhash64("doc", "text"), F.lit(share)) == 0).select("text")
        counts = sample.mapInArrow(_seeds(length, often), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        found = counts.where(F.col("n") >= times).orderBy(F.desc("n"), "h").limit(number).collect()
        return np.sort(np.asarray([r.h for r in found], np.int64))

    often = most(FEW, SEEN, DEMOTED, None)
    return often, most(SAMPLE, OFTEN, COMMON, often)


def _find(length: int, often: np.ndarray, common: np.ndarray):
    """Kinds: 0 an anchor, 1 a span, 3 an anchor of a common seed, plus four times the bytes before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FOUND.split(", ")]
        last = demotion(often)
        for batch in batches:
            parts: list[np.ndarray] = []
            for doc, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = _bytes(text.as_py())
                at, h, a, b = anchors(raw, length, last)
                if not len(at):
                    continue
                b = b + length
                c = substring_hash(raw, a, b) ^ _mix((at - a).astype(np.uint64) + np.uint64(1 << 40))
                n = len(at)
                parts.append(np.stack([h, c.view(np.int64), np.full(n, doc), np.full(n, tie), at, a, b]))
            if not parts:
                continue
            h, c, doc, tie, at, a, b = np.concatenate(parts, axis=1)
            order = np.lexsort((at, tie, doc, c, h))
            again = np.zeros(len(order), bool)
            h2, c2 = h[order], c[order]
            again[order[1:]] = (h2[1:] == h2[:-1]) & (c2[1:] == c2[:-1])
            one = order[1:][(doc[order[1:]] == doc[order[:-1]]) & (tie[order[1:]] == tie[order[:-1]])
                            & (at[order[1:]] == at[order[:-1]])]
            drop = np.zeros(len(order), bool)
            drop[one] = True  # a repeated row
            sent = ~again
            spans = again & ~drop
            rows = np.flatnonzero(sent | spans)
            kind = np.where(sent[rows], np.where(_among(h[rows], common), 3, 0), 1).astype(np.int32)
            # spans need no seed: any key deals them out
            key = np.where(kind != 1, h[rows], (doc[rows] * 31 + at[rows]))
            pos = np.where(kind != 1, at[rows], a[rows])
            yield pa.record_batch([
                pa.array((kind + 4 * (pos - a[rows])).astype(np.int32)), pa.array(key), pa.array(c[rows]), pa.array(doc[rows]),
                pa.array(tie[rows]), pa.array(pos.astype(np.int32)), pa.array(b[rows].astype(np.int32))], names=names)
    return run


def _judge(length: int, chunk_contexts: int, most: int):
    """Rows sorted by kind, h, c, doc, tie, pos: repeats become spans, differing neighbourhoods of a seed go on.

    ``most`` rows are looked at together. Of a seed that reaches beyond them only the earliest of each neighbourhood are
    held, and as soon as these are more than a chunk they go on and none is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in JUDGED.split(", ")]
        held: list[pa.RecordBatch] = []
        told = False  # the first row held and its seed's earlier ones have gone on

        def flush(t: pa.Table, open_end: bool) -> tuple[pa.RecordBatch, pa.Table, bool]:
            """What goes on, what of the last seed is held if it may have more rows, and whether that has gone on."""
            kind, h, c, doc, tie, pos, stop = (col.to_numpy() for col in t.columns)
            kind, start = kind & 3, pos - (kind >> 2)
            n = len(h)
            anchor = kind != 1
            same_h, same_c = np.zeros(n, bool), np.zeros(n, bool)
            same_h[1:] = (kind[1:] == kind[:-1]) & anchor[1:] & (h[1:] == h[:-1])
            same_c[1:] = same_h[1:] & (c[1:] == c[:-1])
            first = anchor & ~same_c
            at = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            own = (doc == doc[at]) & (tie == tie[at]) & (pos == pos[at])
            span = ~anchor | same_c & ~own & (stop - start >= length)
            group = np.cumsum(~same_h) - 1
            different = np.bincount(group[first], minlength=int(group[-1]) + 1)
            different[group[kind == 3]] = chunk_contexts + 1
            if told:
                different[0] = chunk_contexts + 1
            more = first & (different[group] > 1)
            more[0] &= not told
            keep, gone = t.slice(n), False
            if open_end and anchor[-1]:
                gone = bool(different[-1] > chunk_contexts)
                last = np.flatnonzero(first & (group == group[-1]))
                keep = t.take(pa.array(last[-1:] if gone else last))
                if not gone:
                    more[last] = False
            rows = np.flatnonzero(span | more)
            out = np.where(more[rows], 2, 1).astype(np.int32)
            return pa.record_batch([
                pa.array(out), pa.array(h[rows]), pa.array(np.where(out == 2, different[group[rows]], 0)),
                pa.array(doc[rows]), pa.array(tie[rows]),
                pa.array(np.where(out == 2, pos[rows], start[rows]).astype(np.int32)), pa.array(stop[rows]),
                pa.array(start[rows].astype(np.int32))], names=names), keep, gone

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size < most:
                continue
            out, rest, told = flush(pa.Table.from_batches(held), True)
            yield out
            held, size = rest.to_batches(), 0  # what is held is at most a chunk
        if held:
            yield flush(pa.Table.from_batches(held), False)[0]
    return run


def windows(reach: int) -> list[tuple[int, int]]:
    """Bytes to the left and right of a seed, so that every string around it contains one of these windows whole."""
    step = -(-(reach + 1) // PARTS)
    return [(i * step, max(0, reach - ((i + 1) * step - 1))) for i in range(PARTS)]


def window_keys(contexts: Sequence[bytes], seed: np.ndarray, reach: int) -> np.ndarray:
    """A hash per context and window; windows that reach over the context's edge have hashes of their own."""
    size = np.asarray([len(c) for c in contexts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    text = np.frombuffer(b"".join(contexts), np.uint8)
    at = begin[:-1] + seed
    out = np.empty((len(contexts), PARTS), np.int64)
    own = np.arange(len(contexts), dtype=np.uint64) << np.uint64(3)
    for i, (left, right) in enumerate(windows(reach)):
        ok = (seed >= left) & (seed + SEED + right <= size)
        a, b = np.where(ok, at - left, 0), np.where(ok, at + SEED + right, 0)
        tag = _mix(np.full(len(contexts), i + 1, np.uint64))
        out[:, i] = np.where(ok, substring_hash(text, a, b) ^ tag, _mix(own | np.uint64(i)) | np.uint64(1)).view(np.int64)
    return out


def _fetch(chunk_contexts: int):
    """Neighbourhoods keyed by their seed; those of seeds beyond a chunk have no key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CONTEXTS.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for doc, tie, packed, found in zip(*(c.to_pylist() for c in batch.columns)):
                raw = zlib.decompress(packed)
                for one in found:
                    a, at = one["start"], one["pos"]
                    rows.append((one["h"] if one["c"] <= chunk_contexts else None, doc, tie, a, at - a, raw[a:one["stop"]]))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    return run


def _windowed(length: int, keys_only: bool):
    """A row for each window that lies in the neighbourhood whole: no string holds one that does not."""
    reach = length - SEED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in WINDOWED.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            contexts, seed = batch.column(5).to_pylist(), batch.column(4).to_numpy().astype(np.int64)
            keys = window_keys(contexts, seed, reach)
            size = np.asarray([len(c) for c in contexts])
            ok = np.stack([(seed >= left) & (seed + SEED + right <= size) for left, right in windows(reach)], axis=1)
            row, part = np.nonzero(ok)
            key = pa.array(keys[row, part])
            if keys_only:
                yield pa.record_batch([key], names=["key"])
            else:
                rest = batch.take(pa.array(row))
                yield pa.record_batch([key, *rest.columns[1:], pa.array(part.astype(np.int32))], names=names)
    return run


def _strings(length: int):
    """The strings of a neighbourhood that are the part of a window: two hashes and the place of each."""
    reach = length - SEED
    step = -(-(reach + 1) // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in STRINGS.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, tie, start, seed, part = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3, 4, 6))
            for lo in range(0, len(doc), 1024):
                contexts = batch.column(5)[lo:lo + 1024].to_pylist()
                size = np.asarray([len(c) for c in contexts])
                begin = np.concatenate([[0], np.cumsum(size)])[:-1]
                shift = part[lo:lo + 1024, None] * step + np.arange(step)[None, :]
                off = seed[lo:lo + 1024, None] - shift
                row, col = np.nonzero((shift <= reach) & (off >= 0) & (off + length <= size[:, None]))
                off = off[row, col]
                text, at = np.frombuffer(b"".join(contexts), np.uint8), begin[row] + off
                one, two = (substring_hash(text, at, at + length, f).view(np.int64) for f in (0, 1))
                row += lo
                yield pa.record_batch([pa.array(one), pa.array(two), pa.array(doc[row]), pa.array(tie[row]),
                                       pa.array((start[row] + off).astype(np.int32))], names=names)
    return run


def _later(windowed: DataFrame, length: int) -> DataFrame:
    """Spans of all strings of ``windowed`` that are not the earliest of their kind."""
    strings = windowed.mapInArrow(_strings(length), STRINGS)
    place = F.struct("doc", "tie", "pos")
    first = durable(strings.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                    .where("first < last").drop("last"))
    return (strings.join(first, ["one", "two"]).where(place > F.col("first"))
            .select("doc", "tie", "pos", (F.col("pos") + length).cast("int").alias("stop")))


def word_ranks(text: np.ndarray) -> np.ndarray:
    """Dense rank of the eight bytes that start at each position; zeros follow the end."""
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(len(text), np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | wide[j:j + len(text)].astype(np.uint64)
    order = np.argsort(key).astype(np.int32)
    fresh = np.ones(len(text), bool)
    key = key[order]
    fresh[1:] = key[1:] != key[:-1]
    del key
    rank = np.empty(len(text), np.int32)
    rank[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return rank


def sort_small_suffixes(rows: np.ndarray, left: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """``rows`` (positions) by their first ``depth`` bytes, ``left`` of which stand before the text's end; ties by
    position. Three ranks of eight bytes make one key, and only tied rows are looked at again."""
    order = rows.copy()
    todo = np.arange(len(rows), dtype=np.int32)
    group = np.zeros(len(rows), np.int32)
    padded = np.concatenate([rank, np.zeros(depth + 32, np.int32)])
    for at in range(0, depth, 24):
        p = order[todo]
        key = np.zeros(len(p), np.int64)
        for o in (at, at + 8, at + 16):
            key = (key << 21) | np.where(left[p] > o, padded[p + o] + 1, 0)
        by = np.lexsort((key, group[todo])) if at else np.argsort(key, kind="stable")
        order[todo], key = p[by], key[by]
        g = group[todo]
        fresh = np.ones(len(todo), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        group[todo] = todo[np.maximum.accumulate(np.where(fresh, np.arange(len(todo)), 0))]
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        todo = todo[tied]
        if not len(todo):
            break
    return order


def two_stage_suffix_array(text: np.ndarray, width: int, depth: int, rank: np.ndarray | None = None) -> np.ndarray:
    """Suffix order of ``text``, rows of ``width`` bytes that each end in at least one 0, correct to ``depth`` bytes.

    Suffixes that begin with 0 are left out: they end there. A suffix smaller than its successor is sorted directly;
    then buckets of equal first bytes are scanned from the smallest, and the predecessor of every suffix met, if it is
    larger than its successor, takes the next place at the front of its own bucket."""
    n = len(text)
    rank = word_ranks(text) if rank is None else rank
    step = np.diff(text.astype(np.int16), append=0)
    # the first differing successor decides; equal bytes pass the verdict on
    change = np.flatnonzero(step != 0).astype(np.int32)
    rising = np.repeat(step[change] > 0, np.diff(change, prepend=np.int32(-1)))
    small = np.zeros(n, bool)
    small[:len(rising)] = rising
    small &= text > 0
    del step, change, rising
    left = (width - np.arange(n, dtype=np.int32) % width).astype(np.int32)
    direct = sort_small_suffixes(np.flatnonzero(small).astype(np.int32), left, rank, depth)
    del left
    cuts = np.searchsorted(text[direct], np.arange(257))  # directly sorted suffixes by first byte
    large: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~small[before] & (text[before] > 0)]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for part, byte in zip(np.split(before, at[1:]), first[at].tolist()):
                large[byte].append(part)

    ends = np.flatnonzero((text == 0) & np.concatenate([[False], text[:-1] > 0])).astype(np.int32)
    induce(ends)
    out = []
    for byte in range(1, 256):
        done = 0
        while done < len(large[byte]):  # suffixes of this bucket may bring in others of it, which come behind them
            ready = large[byte][done:]
            done += len(ready)
            induce(np.concatenate(ready) if len(ready) > 1 else ready[0])
        out += large[byte]
        mine = direct[cuts[byte]:cuts[byte + 1]]
        induce(mine)
        out.append(mine)
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def common_prefix_reaches(sa: np.ndarray, left: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares its first ``length`` bytes with the one before it in the order."""
    same = np.zeros(len(sa), bool)
    pairs = np.arange(1, len(sa), dtype=np.int32)
    pairs = pairs[(left[sa[pairs]] > length) & (left[sa[pairs - 1]] > length)]
    for o in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        pairs = pairs[rank[sa[pairs] + o] == rank[sa[pairs - 1] + o]]
    same[pairs] = True
    return same


def repeated_starts(contexts: Sequence[bytes], order: np.ndarray, base: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of strings that also start earlier. ``order`` numbers the documents of the contexts in their
    order, ``base`` is where each context starts in its document."""
    width = max(map(len, contexts)) + 8
    text = np.zeros(len(contexts) * width, np.uint8)
    grid = text.reshape(len(contexts), width)
    size = np.asarray([len(c) for c in contexts])
    grid[np.arange(width)[None, :] < size[:, None]] = np.frombuffer(b"".join(contexts), np.uint8) + 1  # no byte 255 in UTF-8
    rank = word_ranks(text)
    sa = two_stage_suffix_array(text, width, length, rank)
    left = (size[:, None] - np.arange(width)[None, :] + 1).astype(np.int16 if width < 1 << 15 else np.int32).reshape(-1)
    same = common_prefix_reaches(sa, left, rank, length)
    del text, grid, rank, left
    run = np.cumsum(~same, dtype=np.int32)
    many = same.copy()
    many[:-1] |= same[1:]
    sa, run = sa[many], run[many]
    if not len(sa):
        return sa, sa
    ctx, off = sa // width, sa % width
    where = base[ctx] + off
    by = np.lexsort((where, order[ctx], run))
    ctx, off, run, where = ctx[by], off[by], run[by], where[by]
    head = np.concatenate([[True], run[1:] != run[:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(len(run)), 0))
    later = (order[ctx] != order[ctx[first]]) | (where != where[first])
    return ctx[later], off[later]


def _sort(length: int):
    reach = length - SEED
    width = length + reach + 8
    most = CHUNK // width // 2  # as many as a key may hold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(rows: pa.Table) -> pa.RecordBatch:
            doc, tie, start = (rows.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
            contexts = rows.column(5).to_pylist()
            order = np.unique(np.stack([doc, tie], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
            ctx, off = repeated_starts(contexts, order, start, length)
            key = np.unique(ctx * width + off)
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1] + 1
            tail = np.ones(len(key), bool)
            tail[:-1] = head[1:]
            ctx, a, b = key[head] // width, key[head] % width, key[tail] % width
            return pa.record_batch([pa.array(doc[ctx]), pa.array(tie[ctx]), pa.array((start[ctx] + a).astype(np.int32)),
                                    pa.array((start[ctx] + b + length).astype(np.int32))], names=["doc", "tie", "pos", "stop"])

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            contexts, seed = rows.column(5).to_pylist(), rows.column(4).to_numpy().astype(np.int64)
            keys = window_keys(contexts, seed, reach)
            _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
            rows = rows.filter(pa.array((times[which.reshape(keys.shape)] > 1).any(axis=1)))
            key = rows.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
            begin = 0
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - begin > most and a > begin:
                    yield spans(rows.slice(begin, a - begin))
                    begin = a
            if begin < len(key):
                yield spans(rows.slice(begin))

        pa.default_memory_pool().release_unused()  # of earlier stages of the same worker
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size < most:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column(0).to_numpy()
            last = int(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1])
            if last:
                yield from flush(rows.slice(0, last))
                rest = rows.slice(last)
                held, size = rest.to_batches(), rest.num_rows
        if held:
            yield from flush(pa.Table.from_batches(held))
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [zlib.compress((x.as_py() or "").encode(), 1) for x in batch.column(2)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                              names=["doc", "tie", "packed"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, packed, spans in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            raw = zlib.decompress(packed.as_py())
            flat = np.zeros(0, np.int64)
            if spans.is_valid:
                both = np.sort(spans.values.to_numpy())  # start in the high half, stop in the low
                start, stop = both >> 32, np.maximum.accumulate(both & 0xFFFFFFFF)
                head = np.ones(len(both), bool)
                head[1:] = start[1:] > stop[:-1]
                last = np.ones(len(both), bool)
                last[:-1] = head[1:]
                flat = np.stack([start[head], stop[last]], axis=1).reshape(-1)
            kept, view = hashlib.sha256(), memoryview(raw)
            for a, b in zip([0, *flat[1::2].tolist()], [*flat[::2].tolist(), len(raw)]):
                kept.update(view[a:b])
            rows.append((doc, len(raw), int((flat[1::2] - flat[::2]).sum()), len(flat) // 2, kept.hexdigest(), flat))
        if rows:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``docs`` (doc_id, text); spans are the
    removed byte ranges start, end, start, end, ...

    Null and empty texts have no bytes; texts shorter than ``length`` lose nothing. Rows with one id are ordered by the
    hash of their text, and rows alike in both are one document that is returned as often as it occurs. A null id
    counts as smaller than all others. ``length`` is at least 2 * SEED."""
    if length < 2 * SEED:
        raise ValueError(f"strings must have {2 * SEED} bytes at least")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col("text").alias("text"))
    unique = rows.groupBy("doc").count().where("count > 1").isEmpty()
    rows = rows.select("doc", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("tie"), "text")
    chunk_contexts = CHUNK // (2 * length - SEED + 8) // 2
    kind = F.col("kind").bitwiseAND(3)
    found = (rows.mapInArrow(_find(length, *common_seeds(rows, length)), FOUND)
             .repartition(n, "h", F.when(kind == 3, F.col("c")))
             .sortWithinPartitions(kind, "h", "c", "doc", "tie", "pos")
             .mapInArrow(_judge(length, chunk_contexts, HELD), JUDGED))
    found = durable(found)
    wanted = (found.where("kind = 2").groupBy("doc", "tie")
              .agg(F.collect_list(F.struct("h", "c", "pos", "start", "stop")).alias("found")))
    packed = rows.mapInArrow(_pack, "doc long, tie long, packed binary")
    once = packed if unique else packed.dropDuplicates(["doc", "tie"])
    contexts = once.join(wanted, ["doc", "tie"]).mapInArrow(_fetch(chunk_contexts), CONTEXTS)
    later = None
    if not found.where((F.col("kind") == 2) & (F.col("c") > chunk_contexts)).isEmpty():
        contexts = durable(contexts)
        wide = contexts.where("key IS NULL")
        hot = durable(wide.mapInArrow(_windowed(length, True), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
                      .where(F.col("n") > chunk_contexts).select("key"))
        windowed = wide.mapInArrow(_windowed(length, False), WINDOWED)
        if not hot.isEmpty():
            later = _later(windowed.join(hot, "key", "left_semi"), length)
            windowed = windowed.join(hot, "key", "left_anti")
        contexts = contexts.where("key IS NOT NULL").unionByName(windowed.drop("part"))
    sorted_out = durable(contexts.repartition(n, "key").sortWithinPartitions("key", "doc", "tie", "start")
                         .mapInArrow(_sort(length), SPANS))
    spans = found.where("kind = 1").select("doc", "tie", "pos", "stop").unionByName(sorted_out)
    if later is not None:
        spans = spans.unionByName(later)
    both = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("stop").cast("long"))
    spans = spans.groupBy("doc", "tie").agg(F.collect_list(both).alias("spans"))
    cut = packed.join(spans, ["doc", "tie"], "left").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))
