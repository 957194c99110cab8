"""Every registered query of the subpackage against its plain version, on whole small tables."""

import os
import sys

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from compare import connect, difference  # noqa: E402

from cohortloom.llm import ORACLE, QUERIES, html_text, tokens  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(*t.to_pydict().values()))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def encoded(texts):
    whole = tokens.encoder(tokens.word_vocabulary()).tokenizer
    return [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


def test_token_files(spark, texts):
    want, at = [], 0
    order = sorted(texts)
    for (d, _), ids in zip(order, encoded([t for _, t in order])):
        want.append((d, at, len(ids) + 1, brute.crc([*ids, 2])))
        at += len(ids) + 1
    assert rows(QUERIES["op1_token_files"](spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_secrets(spark, texts):
    want = []
    for d, t in texts:
        s = brute.secrets(t)
        want.append((d, brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in s))))
    assert rows(QUERIES["op2_secrets"](spark, SF), "doc_id", "base_sha256") == sorted(want)


def test_decontamination(spark, texts):
    t = pq.read_table(f"{SF}/benchmark.parquet", columns=["item_id", "text"])
    want = brute.contamination(texts, list(zip(*t.to_pydict().values())))
    assert rows(QUERIES["op3_decontamination"](spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256",
                "contaminated") == sorted(want)


def test_toxicity(spark, texts):
    out = QUERIES["op4_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(d for d, _ in texts)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)


def test_toxicity_held_out(spark):
    """Accuracy on rows that never teach, over the largest small table."""
    sf = "/root/testdata/sf0.1"
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall()
    toxic = dict(labels)
    out = [r for r in QUERIES["op4_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    hit = [r for r in out if r.predicted]
    assert np.mean([toxic[r.doc_id] for r in hit]) > 0.9
    assert sum(toxic[r.doc_id] for r in hit) > 0.75 * sum(toxic[r.doc_id] for r in out)


def test_packing(spark, texts):
    want = []
    for (d, _), ids in zip(texts, encoded([t for _, t in texts])):
        ids = [*ids, 0]
        want += [(d, n, s, len(ids[s:s + 2048]), brute.crc(ids[s:s + 2048])) for n, s in enumerate(range(0, len(ids), 2048))]
    out = QUERIES["op5_packing"](spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    total = sum(r.length for r in out)
    assert len({r.sequence_id for r in out}) <= 1.02 * -(-total // 2048) + 1


def test_html(spark):
    t = pq.read_table(f"{SF}/pages.parquet", columns=["page_id", "html"]).to_pydict()
    want = sorted((i, html_text.main_text(h)) for i, h in zip(t["page_id"], t["html"]))
    assert rows(QUERIES["op6_html_text"](spark, SF), "page_id", "text") == want
    assert want == sorted((i, brute.article(h)) for i, h in zip(t["page_id"], t["html"]))
    assert all(x for _, x in want)


def test_quality(spark, texts):
    got = rows(QUERIES["op7_quality"](spark, SF), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
               "n_repeat_words", "base_failed")
    assert got == sorted((d, *brute.quality(t)) for d, t in texts)
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    judged = [r for r in QUERIES["op7_quality"](spark, SF).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept == bool(labels[r.doc_id]) for r in judged)


def test_repeats(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in QUERIES["op9_suffix_dedup"](spark, SF).collect()}
    assert got == brute.repeats(texts)


def test_near_duplicates(spark, texts):
    got = rows(QUERIES["op10_simhash"](spark, SF), "doc_id", "fingerprint", "component_id")
    assert got == sorted((d, *f) for (d, _), f in zip(texts, brute.near(texts)))


def test_divergence(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["lang", "source", "text"]).to_pydict()
    want = brute.divergence(list(zip(t["lang"], t["source"], t["text"])))
    assert rows(QUERIES["op11_divergence"](spark, SF), "lang", "source", "part", "item", "value", "rank") == want
    assert {w[2] for w in want} == {"pair", "term"}


def test_pivot_search(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    want = brute.nearest(list(zip(t["vec_id"], t["embedding"])))
    assert rows(QUERIES["op12_pivot_search"](spark, SF), "query_id", "rank", "vec_id", "score") == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_conversation_repair(spark, sf):
    sf = f"/root/testdata/{sf}"
    t = pq.read_table(f"{sf}/conversations.parquet").to_pydict()
    found = brute.damaged(zip(t["conv_id"], t["turn"], t["role"], t["text"]))
    want = sorted((c, *(x := brute.repaired(r))[:-1], brute.sha(x[-1])) for c, r in found.items())
    assert rows(QUERIES["op13_conversation_repair"](spark, sf), "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal",
                "cost", "audit", "repaired_sha256") == want
