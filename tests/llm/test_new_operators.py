"""Source divergence, pivot search and conversation repair on odd rows, against plain versions."""

import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from cohortloom.llm import conversation_repair as repair  # noqa: E402
from cohortloom.llm import divergence, pivot_search  # noqa: E402


def tuples(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: [(x is not None, x) for x in t])


# --- divergence -------------------------------------------------------------------------------------------------------

def test_runs_are_sorted_and_complete(monkeypatch):
    monkeypatch.setattr(divergence, "SMALL", 32)  # so that slices are partitioned and go deeper
    draw = random.Random(3)
    stock = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefgh" * 5, "abcdefgh" * 5 + "x", "é" * 20, "日本語", "zz"]
    texts = [" ".join(draw.choice(stock) for _ in range(draw.randrange(60))) for _ in range(80)] + ["", "1 2 3", "Éa", "x"]
    words = divergence.Words(pa.array(texts))
    order, begin = divergence.equal_runs(words, np.arange(len(words.start)))
    spelled = words.spelled(order).to_pylist()
    assert spelled == sorted((w for t in texts for w in brute.terms(t)), key=str.encode)
    heads = [i for i in range(len(spelled)) if i == 0 or spelled[i] != spelled[i - 1]]
    assert begin.tolist() == heads


@pytest.mark.parametrize("shard_bytes", [1, 40, 1 << 20])
def test_term_counts_do_not_depend_on_shards(spark, shard_bytes):
    docs = [("en", "a", "The cat. THE dog"), ("en", "a", "the"), ("en", "b", None), (None, None, "x the"), ("en", "a\0", "the")]
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    want = {}
    for lang, source, text in docs:
        for w in brute.terms(text):
            n = want.setdefault((lang or "", source or "", w), [0, set()])
            n[0] += 1
            n[1].add((lang, source, text))
    got = tuples(divergence.term_counts(df, shard_bytes), "lang", "source", "term", "n", "df")
    assert got == sorted((*k, n, len(d)) for k, (n, d) in want.items())


def test_divergence_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 8)  # several blocks of terms
    draw = random.Random(5)
    words = [f"w{chr(97 + i)}" for i in range(12)] + ["Ünder", "ünder"]
    docs = [(draw.choice(["en", "de", None]), draw.choice(["a", "b", "c", None]),
             draw.choice([None, "", "7 %"] + [" ".join(draw.choices(words, k=9))] * 9)) for _ in range(160)]
    docs += [("fr", "only", "mot"), ("fr", "other", None), ("en", "hot", "wa " * 5000)] + [("en", "copies", "wb wc wd")] * 40
    df = spark.createDataFrame([(*d, 1) for d in docs], "lang string, source string, text string, term int")
    cols = ("lang", "source", "part", "item", "value", "rank")
    assert tuples(divergence.divergence(df, least_docs=10, top=4), *cols) == brute.divergence(docs, 10, 4)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_are_exact_beyond_a_long(spark):
    n, total, terms = 3 * 10 ** 15, 10 ** 16 + 7, 123_456_789
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 10 ** 9 * (n + 5) // (total + 5 * terms)


# --- pivot search -----------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, score string"


def near(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(3)
    return tuples(pivot_search.top_k(df, **how), "query_id", "rank", "vec_id", "score")


def test_nearest_among_clusters(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(6, 8)) * 4
    rows = [(i, (centres[i % 6] + draw.normal(size=8) * 0.1).tolist()) for i in range(600)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    assert near(spark, rows, k=7, every=10, sample=50, pivots=6) == brute.nearest(rows, 7, 10)


def test_nearest_with_ties_repeats_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [1.0, 0.5]), (3, [1.0, 0.5]), (4, []), (40, [-1.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, None), (None, [9.0, 9.0]), (8, [None, 1.0]), (60, [1e6, -1e6]), (9, [0.01, -0.01]), (-20, [3.0])]
    padded = [(i, None if v is None else v + [0.0] * (2 - len(v))) for i, v in rows]
    assert near(spark, rows, k=3) == brute.nearest(padded, 3)
    assert near(spark, rows, k=50, group_bytes=100) == brute.nearest(padded, 50)  # several groups, fewer rows than k


def test_nearest_beyond_whole_doubles(spark):
    rows = [(20 * i, [float(np.float32(3e9 + 999 * i)), float(np.float32(-7e8 * i)), 1.5]) for i in range(6)]
    want = [(q, r, v, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, v, s in brute.nearest(rows, 3)]
    assert [x[:2] + x[3:] for x in near(spark, rows, k=3)] == [x[:2] + x[3:] for x in sorted(want)]


def test_nearest_of_nothing(spark):
    assert near(spark, []) == []
    assert near(spark, [(1, [1.0])]) == [] and near(spark, [(20, [1.0])]) == []


# --- conversation repair ----------------------------------------------------------------------------------------------

ROWS = "conv_id long, turn long, role string, text string, k string"
OUT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")


def plain(rows):
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    return sorted(((c, *brute.repaired(r)) for c, r in by.items()), key=lambda t: (t[0] is not None, t[0] or 0))


@pytest.mark.parametrize("seed", range(4))
def test_random_conversations(spark, seed):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "s", "tool", "User", "", None]
    texts = ["Yes.", "No!", "Why?", "cut", " \t\n", "", None, "Done. \x0b", "é."]
    rows = [(draw.choice([*range(30), None]), draw.choice([None, *range(12)]), draw.choice(roles[:3] * 3 + roles),
             draw.choice(texts), "x") for _ in range(500)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    assert tuples(repair.repair(df), *OUT) == plain(rows)


def test_a_conversation_over_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_ROWS", 7)
    draw = random.Random(9)
    rows = [(5, t // 2, draw.choice(["user", "assistant", "tool"]), draw.choice(["Yes.", f"No {t}.", f"cut {t}", ""]), "x")
            for t in range(900)]
    rows += [(c, 0, "user", "Alone.", "x") for c in range(12)] + [(7, 1, "assistant", "Again.", "x")] * 300
    got = repair.repair(spark.createDataFrame(rows, ROWS).repartition(4))
    assert tuples(got, *OUT) == plain(rows)
    sums = {r.conv_id: r.repaired_sha256 for r in got.collect()}
    assert all(sums[c] == brute.sha(x[-1]) for c, *x in plain(rows))


def test_the_walk_needs_only_checkpoints():
    draw = random.Random(2)
    for n in (0, 1, 2, 15, 16, 17, 400):
        kinds = bytes(draw.choice([0, 3, 4, 5, 6, 7, 8, 9, 11, 12, 15]) for _ in range(n))
        walk = repair.Walk(kinds, repair.Steps.inserted(repair.END))
        assert len(walk.marks) <= 2 * int(n ** 0.5) + 2
        cut = n // 3
        costs = repair.part_costs(kinds[cut:])
        behind = [min(costs[4 * s + e] + repair.Steps.inserted(repair.END)[e] for e in range(4)) for s in range(4)]
        assert repair.Walk(kinds[:cut], behind).cost == walk.cost
        first = list(repair.Walk(kinds[:cut], behind).edits(repair.START))
        assert first == list(walk.edits(repair.START))[:cut]


def test_damaged_rows(spark):
    rows = [(c, t, "assistant", f"Say {t}. Why? No!", "x") for c in (None, 1, 2) for t in (None, *range(60))]
    rows += [(3, None, None, None, "x"), (4, 1, "user", None, "x")]
    got = repair.damage(spark.createDataFrame(rows, ROWS)).where("NOT gone")
    want = [(c, *r) for c, rs in brute.damaged(r[:4] for r in rows).items() for r in rs]
    key = lambda t: [(x is not None, x) for x in t]
    assert tuples(got, "conv_id", "turn", "role", "text") == sorted(want, key=key)


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    assert repair.repaired_conversations(empty).count() == 0
    gone = spark.createDataFrame([(1, 0, "user", "x.", True)], "conv_id long, turn long, role string, text string, gone boolean")
    assert tuples(repair.repair(gone), *OUT) == [(1, 0, 0, 0, 0, 0, 0, "", "")]
    assert repair.repair(gone).first().repaired_sha256 == brute.sha("")


# --- tokens -----------------------------------------------------------------------------------------------------------

def test_endings_are_parted_without_changing_ids(monkeypatch):
    from cohortloom.llm import tokens
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50)  # words leave and come back
    monkeypatch.setattr(tokens, "LOOKUP_BYTES", 200)
    draw = random.Random(11)
    bits = ["word", "Wort", "élan", "ß", "÷", "don't", "it's", "x1", "7", "12345", "…", "«", "漢字", "é", "<|endoftext|>", " ",
            *"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~'", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85"]
    texts = ["".join(draw.choices(bits, k=draw.randrange(40))) for _ in range(1500)] + [None, "", ".", "a.", ".a", "ä", "end,"]
    encoder = tokens.Encoder(tokens.word_vocabulary())
    whole = encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [a.tolist() for a in encoder.encode(texts)] == [e.ids for e in whole]
