"""Text normalisation, flags, negation, sections, vectors and codes."""

import math

from pyspark.sql import functions as F

from cohortloom.functions import codes, text, vocab
from cohortloom.operators import vectors as W


def _map(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalize(spark):
    got = _map(spark, ["SOB, n/v", "Abd pain - s/p MVC", "  ", None, "a b cp"], text.normalize_text)
    # slash abbreviations cannot match because the slash splits them and single letters are dropped
    assert got == ["shortness of breath", "abdominal pain motor vehicle collision", "", "", "chest pain"]


def test_parts_normalised_apart_join_to_the_normalised_whole(spark):
    rows = [["SOB", "n/v s/p MVC"], ["Abd pain -", "", " a ", "HTN"], ["ΟΔΟΣ", "Ärm (L)"], ["x"], [], [None, "cp; DM", None]]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, p array<string>")
    apart = text.join_normalized(F.transform("p", lambda p: text.normalize_text(p)))
    for r in df.select(apart.alias("apart"), text.normalize_text(F.array_join("p", ", ")).alias("whole")).collect():
        assert r.apart == r.whole


def test_rewrite_longest_first(spark):
    table = {"headache": "X", "bad headache": "headache", "can't breathe": "dyspnea", "in": "IN", "sis": "SIS"}
    rows = ["Bad Headache and I can’t breathe", "headaches", "in In inn", "", None, "été in", "éin in"]
    assert _map(spark, rows, lambda c: text.rewrite_phrases(c, table)) == [
        "headache and I dyspnea", "headaches", "IN IN inn", "", "", "été IN", "éin IN"]


def test_rewrite_keeps_letters_that_fold_without_being_equal(spark):
    got = _map(spark, ["ın the", "ſis the"], lambda c: text.rewrite_phrases(c, {"in": "IN", "sis": "SIS", "the": "THE"}))
    assert got == ["ın THE", "ſis THE"]


def test_history_flags_and_negation(spark):
    rows = ["CHF and seizures", "no history of CHF, COPD", "denies a b c d e f asthma", "denies asthma", "non-opioid", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    out = vocab.history_flags(df, "t").orderBy("i").collect()
    got = [[c for c in vocab.HISTORY_CATEGORIES if r[c]] for r in out]
    assert got[0] == ["Circulatory", "Nervous System and Sense Organs"]
    assert got[1] == [] and got[2] == ["Respiratory"] and got[3] == [] and got[5] == []
    meds = vocab.class_flags(spark.createDataFrame([(0, "Non-Opioid analgesics"), (1, "opioids"), (2, "nystatin"), (3, "statins")], "i int, t string"), "t").orderBy("i").collect()
    assert [(r.has_opioid_meds, r.has_cardiac_meds) for r in meds] == [(0, 0), (1, 0), (0, 0), (0, 1)]


def test_every_phrase_raises_its_own_flag(spark):
    df = spark.createDataFrame([(c, p) for c, p in vocab.HISTORY_PHRASES.items()], "c string, t string")
    for r in vocab.history_flags(df, "t").collect():
        assert [c for c in vocab.HISTORY_CATEGORIES if r[c]] == [r.c]


def test_free_list(spark):
    df = spark.createDataFrame([(0, "Metformin 500mg; aspirin and clonazepam"), (1, "IDK"), (2, None), (3, "something")], "i int, t string")
    rows = vocab.classify_free_list(df, "t").orderBy("i").collect()
    assert [(r.n_medications, r.meds_unknown) for r in rows] == [(3, 0), (0, 1), (0, 1), (1, 0)]
    assert (rows[0].has_diabetes_meds, rows[0].has_anticoagulant_meds, rows[0].has_psych_meds, rows[0].has_anticonvulsant_meds) == (1, 1, 1, 1)


def test_section(spark):
    notes = ["HPI: x\nPast Medical History:\n1. CHF\n2. COPD\n\nSocial History: none", "PMH: gerd", "PMHx : gout\nAllergies: nil", "nothing", None]
    assert _map(spark, notes, text.extract_section) == ["1. CHF\n2. COPD", "gerd", "gout", "", ""]


def test_rhythm(spark):
    raw = ["NSR", "Sinus Tachycardia", "sb", "A-Fib", "V-Paced", "1° AVB", "SVT", "sinus arrythmia", "junk", "", None]
    assert _map(spark, raw, text.bucket_rhythm) == ["sinus", "sinus_tachy", "sinus_brady", "afib_flutter", "paced", "av_block", "svt", "sinus", "other", "", ""]


def test_codes(spark):
    df = spark.createDataFrame([("07070", "9"), ("E9320", "9"), ("V7644", "9"), ("I2109", "10"), ("D49", "10"), ("D50", "10"), ("H59", "10"), ("H60", "10"), ("", "9"), ("zz", "9")], "c string, v string")
    got = [(r.r, r.h) for r in df.select(codes.rollup_code(F.col("c"), F.col("v")).alias("r"), codes.code_chapter(F.col("c"), F.col("v")).alias("h")).collect()]
    assert got == [("070", "infectious"), ("E932", "external"), ("V76", "factors"), ("I21", "circulatory"), ("D49", "neoplasms"), ("D50", "blood"),
                   ("H59", "eye"), ("H60", "ear"), ("", ""), ("ZZ", "other")]
    sim = spark.createDataFrame([("I2109", "I2109"), ("I2109", "I219"), ("I2109", "I50"), ("I2109", "J45")], "a string, b string")
    ten = F.lit("10")
    assert [r.s for r in sim.select(codes.code_similarity(F.col("a"), ten, F.col("b"), ten).alias("s")).collect()] == [1.0, 0.6, 0.3, 0.0]


def test_tfidf_formula(spark):
    df = spark.createDataFrame([(1, "Été chest pain chest"), (2, "chest cough"), (3, "x")], "i int, t string")
    grams = W.gram_arrays(df, "i", "t", 1, 1)
    voc = W.fit_vocabulary(grams, 3, 1, 0.95, None)
    assert {r.term: (r.df, r.cf) for r in voc.collect()} == {"ete": (1, 1), "chest": (2, 3), "pain": (1, 1), "cough": (1, 1)}
    w = {(r.i, r.term): r.w for r in W.apply_tfidf(grams, W.fit_tfidf(voc, 3), "i").collect()}
    idf = lambda d: math.log(4 / (1 + d)) + 1
    raw = {"ete": idf(1), "chest": (1 + math.log(2)) * idf(2), "pain": idf(1)}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert all(abs(w[(1, t)] - v / norm) < 1e-12 for t, v in raw.items()) and not any(i == 3 for i, _ in w)


def test_jaccard_and_prf(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    p = text.token_prf(arr(), arr())
    row = spark.range(1).select(text.jaccard(arr("a", "b"), arr("b", "c")).alias("j"), p["f1"].alias("f"), text.token_prf(arr("a"), arr())["f1"].alias("g")).first()
    assert (row.j, row.f, row.g) == (1 / 3, 1.0, 0.0)


def test_words_and_overlap_keep_their_rules(spark):
    from cohortloom.functions import text
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("Ab abc, ab1cde  ABC x", "abc zz"), ("", None), ("cp w/ SOB - a", "chest pain")], "a string, b string")
    a, b = text.token_set(F.col("a")), text.token_set(F.col("b"))
    got = df.select(a.alias("t"), text.token_set(F.col("a"), 1).alias("one"), text.jaccard(a, b).alias("j"), text.normalize_text(F.col("a")).alias("n")).collect()
    assert [r.t for r in got] == [["abc", "cde"], [], ["sob"]]
    assert got[0].one == ["ab", "abc", "cde", "x"]
    assert [r.j for r in got] == [0.5, 0.0, 0.0]
    assert [r.n for r in got] == ["ab abc ab1cde abc", "", "chest pain shortness of breath"]


def test_normalize_looks_up_only_known_words(spark):
    """The map is searched entry by entry, so words must pass the hashed key list first."""
    from cohortloom.functions import text
    from pyspark.sql import functions as F
    plan = spark.range(1).select(text.normalize_text(F.col("id").cast("string")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan.upper()
