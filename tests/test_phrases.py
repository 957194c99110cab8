"""Phrase tables against the alternation of all their keywords."""

import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import vocab as V
from cohortloom.operators import phrases as PH
from cohortloom.operators.phrases import phrase_hits
from cohortloom.session import checkpoint_dir


def both(spark, texts, vocab):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    table = spark.createDataFrame([(k, c) for c, ks in vocab.items() for k in ks], "keyword string, category string")
    rows = [{tuple(r[c] for c in ("id", *sorted(vocab))) for r in V.history_flags(df, "t", v).collect()} for v in (vocab, table)]
    assert rows[0] == rows[1]
    return rows[0]


def test_same_as_the_pattern(spark):
    vocab = {"a": ["chest pain", "pain", "x-ray", "type 2 diabetes"], "b": ["chest", "chest pain on exertion", "d\u00e9j\u00e0 vu", "a"]}
    texts = ["Chest  pain", "chest pains.", "CHEST PAIN on exertion!", "no chest pain or x-ray", "an x-rays", "x- ray", "chest-pain", None, "",
             "type 2 diabetess", "D\u00c9J\u00c0 VU", "painful", "pain", "a", "denies chest\npain. type 2 diabetes", "chest pain " * 3000, "_chest_ pain_"]
    found = both(spark, texts, vocab)
    assert len(found) == len(texts) and any(r[1:] == (1, 1) for r in found)


@pytest.mark.parametrize("seed", range(3))
def test_random_phrases(spark, seed):
    draw = random.Random(seed)
    words = ["a", "b", "bs", "cc", "d1", "\u00e9"]
    join = lambda n: "".join(w + draw.choice([" ", "-", ", "]) for w in draw.choices(words, k=n)).rstrip(" -,")
    vocab = {c: [join(draw.randrange(1, 5)) for _ in range(8)] for c in ("x", "y", "z")}
    both(spark, [join(draw.randrange(12)) for _ in range(150)], vocab)


def test_many_keys(spark):
    keys = [(f"w{i} v{i % 97} u{i % 13}", "odd" if i % 2 else "even") for i in range(30_000)] + [("", "odd"), (None, "odd"), ("(x)", "odd"), ("y", None)]
    table = spark.createDataFrame(keys, "keyword string, category string")
    rows = [(i, f"see w{i} v{i % 97} u{i % 13}s then (x) y") for i in range(0, 30_000, 1000)] + [(-1, "w1 v2 u1"), (-2, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    flags = {r.id: (r.even, r.odd) for r in V.class_flags(df, "t", table).collect()}
    assert flags == {i: (int(i >= 0), 0) for i, _ in rows}


def test_no_phrases(spark):
    df = spark.createDataFrame([(1, "x")], "id long, t string")
    from pyspark.sql import functions as F
    none = spark.createDataFrame([], "keyword string, category string")
    assert phrase_hits(df, "id", F.col("t"), none).count() == 0
    assert V.history_flags(df, "t", none).collect() == df.collect()


def _stored(spark):
    folder = Path(urlparse(checkpoint_dir(spark)).path)
    return {p: p.stat().st_size for p in folder.rglob("*.parquet") if p.is_file()}


def test_texts_are_neither_stored_nor_shuffled(spark):
    """Every word begins a phrase and every token goes on in one, yet only one text in fifty holds a phrase."""
    draw = random.Random(1)
    words = [f"w{i:04d}" for i in range(4000)]
    table = spark.createDataFrame([(f"{w} {v}", "odd" if i % 2 else "even") for i, (w, v) in enumerate(zip(words, words[1:]))],
                                  "keyword string, category string")
    pair = dict(zip(words, words[1:]))
    texts = []
    for i in range(400):
        said = [words[0]]
        while len(said) < 1000:
            word = draw.choice(words)
            if word != pair.get(said[-1]):
                said.append(word)
        texts.append((i, " ".join(said) + (" w0008 w0009" if i % 50 == 0 else " w0009")))
    df = spark.createDataFrame(texts, "id long, t string").repartition(4)
    before = set(_stored(spark))
    hits = {tuple(r) for r in phrase_hits(df, "id", F.col("t"), table).collect()}
    assert hits == {(i, "even") for i in range(0, 400, 50)}
    size = sum(len(t) for _, t in texts)
    assert sum(n for p, n in _stored(spark).items() if p not in before) < size / 8
    runs = PH.phrase_runs(df, F.col("t"), PH.phrase_table(table)).select("id", F.explode("runs")).count()
    assert 8 <= runs < sum(t.count(" ") for _, t in texts) / 20


@pytest.mark.parametrize("common, bits", [(0, 28), (3, 28), (1 << 16, 28), (0, 15)])
def test_common_phrases_and_full_filters_change_nothing(spark, monkeypatch, common, bits):
    """Rows settled by common phrases, by joins or by both; a filter with most of its bits set lets much through, but no more is found."""
    monkeypatch.setattr(PH, "COMMON", common)
    monkeypatch.setattr(PH, "MOST_BITS", bits)
    monkeypatch.setattr(PH, "PORTION", 40)
    draw = random.Random(5)
    words = [f"v{i}" for i in range(60)]
    said = lambda n: " ".join(draw.choices(words, k=n))
    vocab = {c: [said(draw.randrange(1, 4)) for _ in range(n)] for c, n in (("x", 3), ("y", 40), ("z", 4000 if bits == 15 else 9))}
    vocab["y"] += vocab["x"][:2]
    both(spark, [said(draw.randrange(30)) for _ in range(200)] + [None, ""], vocab)


def test_kept_columns(spark):
    df = spark.createDataFrame([(1, "chest pain", "a"), (2, None, "b"), (3, "no chest pain", "c")], "id long, t string, `o.x` string")
    table = spark.createDataFrame([("chest pain", "c1")], "keyword string, category string")
    for vocab in (table, {"c1": ["chest pain"]}):
        assert sorted(map(tuple, V.history_flags(df, "t", vocab, keep=["id"]).collect())) == [(1, 1), (2, 0), (3, 0)]
        assert V.history_flags(df, "t", vocab).columns == ["id", "t", "o.x", "c1"]
