"""Retrieval invariants, splits, audits, sources and heads on small frames."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom import sources
from cohortloom.operators import aggregates as A
from cohortloom.operators import cases as N
from cohortloom.operators import clean as C
from cohortloom.operators import heads as D
from cohortloom.operators import joins as J
from cohortloom.operators import retrieval as T
from cohortloom.operators import splits as S
from cohortloom.operators import vectors as W


def test_simplex_sizes():
    assert len(T.simplex(["text", "vit", "prev"])) == 66 and len(T.simplex(["text", "vit", "hist", "prev"])) == 286
    assert all(abs(sum(w.values()) - 1) < 1e-9 for w in T.simplex(["text", "vit", "hist", "prev"]))


def _index(spark):
    rows = spark.createDataFrame(
        [(1, "A", "a1", "chest pain", 1.0), (2, "A", "a1", "chest pain", 2.0), (3, "A", "a2", "fever", 5.0), (4, "B", "b1", "fall", 0.0)],
        "id int, cat string, code string, title string, v double")
    grams = W.gram_arrays(rows, "id", "title", 1, 1)
    model = W.fit_tfidf(W.fit_vocabulary(grams, 4, 1, 1.0, None), 4)
    vec = W.apply_tfidf(grams, model, "id")
    return T.build_index(rows, vec, "id", "cat", "code", "title", ["v"], ["v"], F.col("id") == 1), model


def test_scores_on_edge_queries(spark):
    index, model = _index(spark)
    q = spark.createDataFrame([(10, "A", "xyz", 5.0), (11, "A", "fever", 5.0), (12, "B", "fall", 0.0)], "id int, cat string, t string, v double")
    vec = W.apply_tfidf(W.gram_arrays(q, "id", "t", 1, 1), model, "id")
    terms = T.score_terms(q.drop("t"), vec, index, "id", "cat", "code", ["v"], ["v"])
    got = {(r.id, r.code): r for r in terms.collect()}
    assert got[(10, "a1")].cos == 0.0 and got[(10, "a1")].text_pos == got[(10, "a2")].text_pos == 0.5
    assert got[(12, "b1")].text_pos == 0.5 and got[(12, "b1")].vit_pos == 0.5
    assert (got[(11, "a2")].text_pos, got[(11, "a1")].text_pos, got[(11, "a1")].prev_pos) == (1.0, 0.0, 1.0)
    assert got[(11, "a2")].m_v == 0.0 and got[(11, "a1")].m_v == 1.0
    assert all(0 <= r.text_pos <= 1 and 0 <= r.vit_pos <= 1 for r in got.values())
    ranked = T.rank_within(terms.withColumn("score", T.blend3({"text": 0.5, "vit": 0.3, "prev": 0.2})), ["id"], "score", ["code"])
    truth = spark.createDataFrame([(10, "A", "nope"), (11, "A", "a2"), (12, "B", "b1")], "id int, cat string, code string")
    rep = T.oracle_recall(ranked, truth, "id", "code").first()
    assert (rep.scored, round(rep.recall_1, 4), round(rep.mrr, 4)) == (3, 0.6667, 0.6667)


def test_tune_counts_absent_code_as_miss(spark):
    index, model = _index(spark)
    q = spark.createDataFrame([(10, "A", "xyz", 5.0), (11, "A", "fever", 5.0)], "id int, cat string, t string, v double")
    vec = W.apply_tfidf(W.gram_arrays(q, "id", "t", 1, 1), model, "id")
    terms = T.score_terms(q.drop("t"), vec, index, "id", "cat", "code", ["v"], ["v"])
    truth = spark.createDataFrame([(10, "nope"), (11, "a2")], "id int, code string")
    out = T.tune(terms, truth, T.simplex(["text", "vit", "prev"], 1), "id", "code", k=1)
    assert [(r.text, r.vit, r.prev, r.hits, r.n) for r in out.orderBy("point").collect()] == [
        (0.0, 0.0, 1.0, 0, 2), (0.0, 1.0, 0.0, 1, 2), (1.0, 0.0, 0.0, 1, 2)]
    assert T.best_point(out, "rate").first().point == 1


def test_grid_hits_of_a_batch_equal_a_plain_count(monkeypatch):
    monkeypatch.setattr(T, "_SCORED", 7)  # questions reach over several portions
    rng = random.Random(5)
    value = lambda: rng.choice([None, *range(-3, 4), 10 ** 9, -10 ** 9])
    lists = [[{"text": value(), "prev": value(), "first": rng.choice([0, 1, None])} for _ in range(rng.choice([0, 1, 5, 20]))] for _ in range(40)]
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("text", "prev", "first")]))
    weights = np.asarray([[0, 10 ** 6], [300000, 700000], [10 ** 6, 0]])
    out = list(T._hits(weights, ["text", "prev"], 3)([pa.record_batch([pa.array(lists, kind)], names=["gaps"])]))
    better = lambda g, w: None not in g.values() and 2 * (w[0] * g["text"] + w[1] * g["prev"]) + g["first"] > 0
    assert [b.to_pydict() for b in out] == [{"point": [0, 1, 2], "hits": [
        sum(sum(better(g, w) for g in gaps) < 3 for gaps in lists) for w in weights.tolist()]}]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("aabc"), min_size=1, max_size=60), st.sampled_from([0.1, 0.2, 0.5]))
def test_split_quota_is_exact(spark, labels, frac):
    df = spark.createDataFrame(list(enumerate(labels)), "id int, y string")
    out = S.stratified_split(df, "y", "id", frac).groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("k")).collect()
    assert sum(r.n for r in out) == len(labels)
    assert all(r.k == int(frac * r.n + 0.5) for r in out)


def test_sampling_needs_enough_rows(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "id int, y int")
    assert S.sample_strata(df, "y", "id", {0: 3, 1: 5}).groupBy("y").count().orderBy("y").collect()[1]["count"] == 5
    with pytest.raises(ValueError):
        S.sample_strata(df, "y", "id", {0: 11})


def test_same_content(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string")
    assert S.same_content(a, a.orderBy(F.desc("i"))) and not S.same_content(a, a.distinct())


def test_mode_and_first_ties(spark):
    df = spark.createDataFrame([("k", "b", 2), ("k", "a", 1), ("k", None, 0), ("j", "z", 5)], "k string, v string, t int")
    assert {r.k: r.v for r in A.mode_by(df, ["k"], "v").collect()} == {"k": "a", "j": "z"}
    assert {r.k: r.v for r in A.first_by(df, ["k"], "t", ["v"]).collect()} == {"k": "a", "j": "z"}


def test_interval_join_bounds(spark):
    ev = spark.createDataFrame([(1, "2150-01-01 00:00:00"), (1, "2150-01-01 04:00:00"), (1, "2150-01-01 04:00:01"), (1, "2149-12-31 23:59:59")], "k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    an = spark.createDataFrame([(1, "2150-01-01 00:00:00")], "k int, a string").withColumn("a", F.col("a").cast("timestamp"))
    assert J.within_window(ev, an, "k", "t", "a", 4).count() == 2


def test_grounding(spark):
    rows = [("I'm 40 and my chest hurts, pain 5/10", 40, 5, "chest pain"), ("I am 41 years old. BP 120/80", 40, -1, "fever"), (" ", 40, 5, "x"),
            ("dyspnea, sob", 40, 5, "unlisted thing"), ("I feel off", 40, 5, "fever, unlisted")]
    df = spark.createDataFrame(rows, "t string, age int, pain int, c string")
    out = N.grounding_audit(df, "t", "age", "pain", "c").collect()
    assert [r.grounded for r in out] == [1, 0, 0, 0, 0]
    assert any("stated age 41" in x for x in out[1].reasons) and any("blood-pressure" in x for x in out[1].reasons) and any("omits" in x for x in out[1].reasons)
    assert out[2].reasons == ["empty narrative"] and out[3].reasons == ["narrative uses clinical jargon: dyspnea, sob"]
    assert out[4].reasons == ["narrative omits complaint(s): fever"]


def test_sources(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "triage.csv").write_text(
        "subject_id,stay_id,temperature,heartrate,resprate,o2sat,sbp,dbp,pain,acuity,chiefcomplaint\n1,2,NaN,80,,98,120,80,x,2,fall\n")
    row = sources.read_table(spark, str(tmp_path / "csv"), "triage", ["stay_id", "temperature", "resprate", "pain"], "csv").first()
    assert (row.stay_id, row.temperature, row.resprate, row.pain) == (2, None, None, "x")
    (tmp_path / "notes.csv").write_text('subject_id,hadm_id,text\n1,,"PMH: a ""b""\nsecond line"\n')
    assert sources.read_notes(spark, str(tmp_path / "notes.csv")).first().text == 'PMH: a "b"\nsecond line'
    assert sources.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0
    codes = spark.createDataFrame([(" 07070 ", "9"), (None, None)], "c string, v string")
    assert [r.c for r in sources.read_codes(codes, "c", "v").collect()] == ["07070", ""]
    built = []
    build = lambda: built.append(1) or spark.range(3)
    keys = spark.range(2)
    for _ in range(2):
        assert sources.cached_features(spark, str(tmp_path / "cache"), keys, ["id"], build).count() >= 2
    assert len(built) == 1
    sources.cached_features(spark, str(tmp_path / "cache"), spark.range(5), ["id"], lambda: built.append(1) or spark.range(5))
    assert len(built) == 2
    for version, n in (("1", 3), ("1", 3), ("2", 4)):
        sources.materialize(spark, str(tmp_path / "mat"), [str(tmp_path / "notes.csv")], version, build)
        assert len(built) == n


def test_heads(spark):
    df = spark.range(200).select("id", (F.col("id") / 200).alias("x"), (F.col("id") % 7).cast("double").alias("z")) \
        .withColumn("y", (F.col("x") > 0.5).cast("int"))
    rows = D.assemble_vector(df, ["x", "z"])
    model = D.fit_binary(rows, "features", "y", maxIter=3, maxDepth=2, seed=1)
    out = D.soft_cascade(rows, model, ["p0", "p1"])
    # tree splits are candidates from a feature sketch, so the exact boundary may fall a row off
    assert out.filter("(p1 >= 0.5) = (y = 1)").count() >= 195
    imp = D.importance_table(spark, model, ["x", "z"], {"x": "main"})
    share = {r.grp: r for r in D.importance_by_group(imp).collect()}
    assert share["main"].pct > 99 and D.top_features(imp, 1).first()["column"] == "x"
    iso = D.calibrate_isotonic(out, "p1", "y")
    cal = D.apply_isotonic(out, iso, "p1", "cal")
    assert D.gate(cal, "cal").filter("y = 0").count() <= 5
    kept, _ = C.exclude_with_audit(df, "y", 7)
    assert kept.count() == 200  # an observation in the same session must not stop the head below
    multi = D.fit_multiclass(rows, "features", "y", maxIter=3)
    assert D.hard_cascade(rows, multi, "c").filter("c = y").count() > 150


def test_cache_serves_wanted_keys_and_finished_versions(spark, tmp_path):
    from cohortloom.sources import cached_features, read_table
    path, calls = f"{tmp_path}/features", []
    full = spark.createDataFrame([(i, i * 10) for i in range(5)], "k int, v int")
    keys = spark.createDataFrame([(1,), (3,)], "k int")

    def build():
        calls.append(1)
        return full
    (tmp_path / "features" / "v000000-dead").mkdir(parents=True)  # a write that died
    for _ in range(2):
        assert sorted(r.k for r in cached_features(spark, path, keys, ["k"], build).collect()) == [1, 3]
    assert len(calls) == 1
    more = spark.createDataFrame([(9,)], "k int")
    assert cached_features(spark, path, more, ["k"], build).count() == 0 and len(calls) == 2
    spark.createDataFrame([(1.0, 2.0), (float("nan"), float("nan"))], "a double, b float").write.parquet(f"{tmp_path}/m.parquet")
    assert sorted(read_table(spark, str(tmp_path), "m").collect(), key=str)[1] == (None, None)


def test_materialize_follows_its_sources(spark, tmp_path):
    from cohortloom.sources import materialize
    spark.range(3).write.parquet(f"{tmp_path}/src")
    build = lambda: spark.read.parquet(f"{tmp_path}/src")
    take = lambda v: materialize(spark, f"{tmp_path}/out", [f"{tmp_path}/src", f"{tmp_path}/none"], v, build).count()
    assert take("1") == 3
    spark.range(2).write.mode("append").parquet(f"{tmp_path}/src")
    assert take("1") == 5 and take("2") == 5


def test_isotonic_fits_scores_as_they_are(spark):
    from cohortloom.operators import heads
    rows = [(0.50001, 0), (0.50002, 1), (0.50001, 0), (0.50002, 1), (0.9, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    out = heads.apply_isotonic(df, heads.calibrate_isotonic(df, "s", "y"), "s", "p").orderBy("s").collect()
    assert [r.p for r in out] == [0.0, 0.0, 1.0, 1.0, 1.0]


def test_content_digest(spark):
    rows = [(i % 50, None if i % 7 == 0 else f"v{i % 11}") for i in range(400)]
    a = spark.createDataFrame(rows, "i long, s string").repartition(3)
    assert S.same_content(a, a.orderBy("s", "i")) and S.content_difference(a, a.repartition(5)).first() == (0, 0)
    plan = S.content_digest(a, a.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(range") == 1
    changed = spark.createDataFrame([*rows[1:], (99, None), (99, None)], "i long, s string")
    assert S.content_difference(a, changed).first() == (1, 2) and not S.same_content(a, changed)
    assert len(S.unequal_ranges(a, changed, a.columns)) <= 2
    empty = a.where("i < 0")
    assert S.content_difference(a, empty).first() == (400, 0) and S.same_content(empty, empty)
    assert not S.same_content(a, a.withColumnRenamed("s", "t"))


def test_isotonic_rows_by_hash(spark):
    from cohortloom.operators import heads
    df = spark.range(4000).selectExpr("id", "(id * 7919 % 4000) / 4000.0 AS s", "cast(id * 31 % 97 < id * 7919 % 4000 / 41 AS int) AS y")
    fits = [heads.calibrate_isotonic(d, "s", "y", max_rows=500, key="id") for d in (df.repartition(3), df.repartition(7))]
    assert fits[0].boundaries == fits[1].boundaries and fits[0].predictions == fits[1].predictions
    assert list(fits[0].predictions) == sorted(fits[0].predictions)


def test_index_is_kept_by_its_store(spark, tmp_path):
    from cohortloom.sources import materialize
    rows = spark.createDataFrame([(i, "c", f"k{i % 3}", "t", float(i), i % 2 == 0) for i in range(9)], "id long, cat string, code string, title string, x double, h boolean")
    rows.write.parquet(f"{tmp_path}/src")
    vectors, built = rows.select("id", F.lit("w").alias("term"), F.lit(1.0).alias("w")), []

    def store(name, build):
        def counted():
            built.append(name)
            return build()
        return materialize(spark, f"{tmp_path}/{name}", [f"{tmp_path}/src"], "1", counted)
    made = [T.build_index(rows, vectors, "id", "cat", "code", "title", ["x"], ["x"], F.col("h"), keep) for keep in (None, store, store)]
    assert built == ["candidates", "centroids"]
    for name in made[0]:
        want, *others = [sorted(map(str, m[name].collect())) for m in made]
        assert all(o == want for o in others) and len(want) == 3


@pytest.mark.parametrize("alpha", [0.0, 0.6, 1.0])
def test_pruned_top_k_equals_all_codes(spark, alpha):
    pick = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    cands = spark.range(900).select(F.concat(F.lit("c"), pick(1, 3)).alias("cat"), F.format_string("k%04d", "id").alias("code"),
                                    F.round(pick(2, 40) / 39, 9).alias("prev_pos"))
    cands = cands.unionByName(spark.createDataFrame([("tiny", "a", 0.0), ("tiny", "b", 1.0)], cands.schema))
    terms = [f"t{i}" for i in range(60)]
    cents = cands.crossJoin(spark.createDataFrame([(t,) for t in terms], "term string")) \
        .where((F.col("cat") == "tiny") | (F.pmod(F.xxhash64("code", "term"), F.lit(40)) == 0)) \
        .select("cat", "code", "term", F.lit(0.5).alias("w"))
    asked = spark.range(40).select("id", F.when(F.col("id") < 3, "tiny").otherwise(F.concat(F.lit("c"), pick(3, 3))).alias("cat"))
    asked = asked.unionByName(spark.createDataFrame([(99, "none")], asked.schema))  # a category without codes
    vec = asked.where("id <> 7").select("id", F.explode(F.array(*[F.concat(F.lit("t"), pick(s, 60)) for s in (4, 5)])).alias("term")).distinct() \
        .withColumn("w", F.round(pick(6, 9) / 9 + 0.1, 3))  # question 7 has no term
    index = {"candidates": cands, "centroids": cents}
    whole = T.score_terms(asked, vec, index, "id", "cat", "code")
    want = T.top_k_within(whole.withColumn("score", T.blend2(alpha)), ["id", "cat"], "score", ["code"], 5)
    got = T.top_k_pruned(asked, vec, index, "id", "cat", "code", alpha, 5)
    cols = ["id", "cat", "code", "score", "rank"]
    rows = sorted(tuple(r[c] for c in cols) for r in got.collect())
    assert rows == sorted(tuple(r[c] for c in cols) for r in want.collect()) and len(rows) == 37 * 5 + 3 * 2
    assert got.where("cat <> 'tiny'").agg(F.max("n_met")).first()[0] < 75  # of 300 codes
