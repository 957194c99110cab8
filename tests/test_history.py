"""History edge cases: ties, cutoffs, first-timers, leakage."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortloom.operators import history as H

T0 = datetime(2150, 3, 14, 12)
STAY = "stay_id bigint, subject_id bigint, intime timestamp, complaint_text_norm string"
ADM = "subject_id bigint, intime timestamp, pmh_a int, pmh_b int"


def _features(spark, stays, ed, adm):
    out = H.history_features(spark.createDataFrame(stays, STAY), spark.createDataFrame(ed, STAY),
                             spark.createDataFrame(adm, ADM), ["pmh_a", "pmh_b"])
    return {r.stay_id: r.asDict() for r in out.collect()}


def test_same_time_and_later_encounters_do_not_count(spark):
    visits = [(1, 7, T0, "chest pain"), (2, 7, T0, "fever"), (3, 7, T0 + timedelta(days=1), "chest pain fever"),
              (4, 8, T0, "fall")]
    adm = [(7, T0, 1, 0), (7, T0 + timedelta(days=2), 0, 1)]
    got = _features(spark, visits, visits, adm)
    assert got[1]["n_prior_ed_visits"] == got[2]["n_prior_ed_visits"] == 0
    assert got[1]["no_history"] == 1 and got[1]["days_since_last_ed"] == 9999.0
    third = got[3]
    assert (third["n_prior_ed_visits"], third["n_prior_admissions"], third["pmh_a"], third["pmh_b"]) == (2, 1, 1, 0)
    assert third["days_since_last_ed"] == 1.0 and third["days_since_last_admission"] == 1.0
    # the tie at T0 takes the larger stay id, whose text is "fever"
    assert third["same_complaint_as_prior"] == round(1 / 3, 4)
    assert got[4]["no_history"] == 1


def test_visits_without_admission(spark):
    visits = [(1, 7, T0, ""), (2, 7, T0 + timedelta(hours=6), "cough")]
    got = _features(spark, visits, visits, [(99, T0, 1, 1)])
    assert got[2]["no_history"] == 0 and got[2]["days_since_last_admission"] == 9999.0
    assert got[2]["days_since_last_ed"] == 0.25 and got[2]["same_complaint_as_prior"] == 0.0


_EVENT = st.tuples(st.integers(1, 3), st.integers(0, 5), st.integers(0, 1))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_EVENT, min_size=1, max_size=12), st.integers(0, 5))
def test_deleting_the_future_changes_nothing(spark, events, cut):
    rows = [(i, s, T0 + timedelta(hours=h), "a b") for i, (s, h, _) in enumerate(events)]
    adm = [(s, T0 + timedelta(hours=h), f, 1 - f) for s, h, f in events]
    now = [(100 + s, s, T0 + timedelta(hours=cut), "chest pain") for s in (1, 2, 3)]
    past = lambda xs, i: [x for x in xs if x[i] < T0 + timedelta(hours=cut)]
    full = _features(spark, now, rows, adm)
    cutoff = _features(spark, now, past(rows, 2) or [(999, 999, T0, "")], past(adm, 1) or [(999, T0, 0, 0)])
    assert full == cutoff


def test_last_prior_value_skips_visits_without_payload(spark):
    df = spark.createDataFrame([(1, 7, T0, 5), (2, 7, T0 + timedelta(days=1), None), (3, 7, T0 + timedelta(days=2), 9)],
                               "stay_id bigint, subject_id bigint, intime timestamp, med int")
    from pyspark.sql import functions as F
    out = H.last_prior_value(df, df, "subject_id", "intime", "stay_id", F.col("med"), F.col("med").isNotNull())
    assert {r.stay_id: r.last_prior for r in out.collect()} == {1: None, 2: 5, 3: 5}


def test_index_round_trip(spark, tmp_path):
    ed = spark.createDataFrame([(1, 10, T0), (2, 20, T0)], "subject_id bigint, stay_id bigint, intime timestamp")
    adm = spark.createDataFrame([(1, 100, T0), (2, 200, T0)], "subject_id bigint, hadm_id bigint, admittime timestamp")
    flags = spark.createDataFrame([(100, 1), (200, 0), (300, 1)], "hadm_id bigint, pmh_a int")
    meds = spark.createDataFrame([(10, 3), (99, 1)], "stay_id bigint, n_medications int")
    index = H.build_history_index(ed, adm, flags, flags, meds, spark.createDataFrame([(1,)], "subject_id bigint"))
    order = {"ed_visits": ["subject_id", "intime"], "admissions": ["subject_id", "admittime"], "icd_flags": ["hadm_id"],
             "note_flags": ["hadm_id"], "med_blocks": ["stay_id"]}
    H.save_history_index(index, str(tmp_path / "index"), order)
    back = H.load_history_index(spark, str(tmp_path / "index"), list(order))
    assert {k: v.count() for k, v in back.items()} == {k: 1 for k in order}


def _visits(spark):
    rows = [(i, (i % 4) or None, T0 + timedelta(hours=(i * 7) % 11) if i % 9 else None, i % 5) for i in range(60)]
    return rows, spark.createDataFrame(rows, "stay_id bigint, subject_id bigint, intime timestamp, v int")


def test_prior_measures_of_common_subjects_and_rows_without_key(spark, monkeypatch):
    from pyspark.sql import functions as F
    rows, df = _visits(spark)
    want = {i: (lambda vs: (sum(vs), max(vs)) if vs else (None, None))(
        [v for _, s2, t2, v in rows if s is not None and t is not None and s2 == s and t2 is not None and t2 < t]) for i, s, t, _ in rows}
    measures = {"total": ("sum", F.col("v").cast("bigint")), "top": ("max", F.col("v"))}
    copy = df.select("subject_id", "intime", "v")
    for hot in (1 << 17, 14, 1):
        monkeypatch.setattr(H, "HOT", hot)
        for events in (df, copy):
            out = H.prior_measures(df, events, "subject_id", "intime", measures)
            assert out.columns == ["subject_id", "intime", "stay_id", "v", "total", "top"]
            assert {r.stay_id: (r.total, r.top) for r in out.collect()} == want


def test_visits_that_are_encounters_are_shuffled_once(spark):
    from pyspark.sql import functions as F
    _, df = _visits(spark)
    out = H.prior_measures(df, df, "subject_id", "intime", {"n": ("sum", F.lit(1).cast("bigint"))})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_history_of_stays_that_are_the_visits_themselves(spark):
    visits = spark.createDataFrame([(i, i % 3, T0 + timedelta(hours=(i * 5) % 7), f"pain {'ab' * (i % 4)} x") for i in range(30)], STAY)
    adm = spark.createDataFrame([(i % 3, T0 + timedelta(hours=i), i % 2, 1) for i in range(6)], ADM)
    rows = lambda ed: sorted(H.history_features(visits, ed, adm, ["pmh_a", "pmh_b"]).collect())
    assert rows(visits) == rows(visits.select("*"))


def test_texts_are_made_for_the_wanted_orders_alone(spark):
    from cohortloom.plans import encounters as E
    sf = "/root/testdata/sf0.001"
    some = E._orders(spark, sf).where("stay_id % 5 = 0")
    rows = lambda df: sorted(map(str, df.collect()))
    got = E._stays(spark, sf, some)
    assert rows(got) == rows(E._stays(spark, sf).where("stay_id % 5 = 0"))
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
