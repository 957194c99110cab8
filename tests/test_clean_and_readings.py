"""Cleaning rules and reading windows on the edge cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import parsing as P
from cohortloom.operators import clean as C
from cohortloom.operators import readings as G

T0 = datetime(2150, 3, 14, 12)


def _values(df, col):
    return [r[col] for r in df.orderBy("i").collect()]


def test_pain_score(spark):
    df = spark.createDataFrame(list(enumerate(["11", "-3", "7.9", "x", None, "0", "10"])), "i int, pain string")
    out = C.clean_bounded_score(df, "pain")
    assert _values(out, "pain") == [-1, -1, 7, -1, -1, 0, 10]
    assert _values(out, "pain_missing") == [0, 0, 0, 1, 1, 0, 0]


def test_acuity_and_age_bins(spark):
    df = spark.createDataFrame(list(enumerate([0.0, 6.0, None, 1.0, 5.0])), "i int, acuity double")
    assert _values(C.valid_int(df, "acuity", 1, 5), "acuity") == [1, 5]
    ages = spark.createDataFrame(list(enumerate([0, 18, 19, 120, 121, None])), "i int, age int")
    assert _values(C.right_closed_bins(ages, "age", [0, 18, 35, 50, 65, 80, 120], 2, "b"), "b") == [2, 0, 1, 5, 2, 2]


def test_clip_and_null_out_differ(spark):
    df = spark.createDataFrame(list(enumerate([300.0, 80.0, None])), "i int, hr double")
    assert _values(C.clip_range(df, {"hr": (20, 250)}), "hr") == [250.0, 80.0, None]
    assert _values(C.null_out_of_range(df, {"hr": (20, 250)}), "hr") == [None, 80.0, None]


def test_age_default_and_limits(spark):
    df = spark.createDataFrame([(0, 60, 2150), (1, None, 2150), (2, 119, 2100)], "i int, a int, y int").withColumn("t", F.lit(T0))
    assert _values(C.age_at(df, "t", "a", "y"), "age") == [60, 50, 120]


def test_exclude_reports_counts(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "g string")
    kept, seen = C.exclude_with_audit(df, "g", "x")
    assert kept.count() == 2
    assert seen.get == {"before": 4, "after": 2}


def test_assemble_rejects_doubled_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert C.assemble(df, {"one": ["b"], "two": ["a"]}).columns == ["b", "a"]
    with pytest.raises(ValueError):
        C.assemble(df, {"one": ["a"], "two": ["a"]})
    assert C.slug("Endocrine, Nutritional, Metabolic") == "endocrine_nutritional_metabolic"


def _at(minutes=0.0, seconds=0.0):
    return str(T0 + timedelta(minutes=minutes, seconds=seconds))


def test_window_block(spark):
    stays = spark.createDataFrame([(1, T0), (2, T0)], "stay_id bigint, intime timestamp")
    blank = [None] * 4
    rows = [(1, _at(), 101.0, 120.0, *blank, "Sinus Rhythm"), (1, _at(240), None, 300.0, *blank, "afib"),
            (1, _at(seconds=-1), 90.0, 20.0, *blank, "paced"), (1, _at(240, 1), 90.0, 20.0, *blank, "paced"),
            (1, "not a time", 90.0, 20.0, *blank, "paced"), (1, _at(10), None, 50.0, *blank, ""), (3, _at(), 99.0, 80.0, *blank, None)]
    vs = spark.createDataFrame(rows, "stay_id bigint, charttime string, temperature double, heartrate double, resprate double, "
                                     "o2sat double, sbp double, dbp double, rhythm string").withColumn("charttime", P.parse_ts(F.col("charttime")))
    out = [r.asDict() for r in G.longitudinal_features(vs, stays).collect()]
    assert len(out) == 1
    r = out[0]
    assert (r["heartrate_min"], r["heartrate_max"], r["heartrate_last"], r["heartrate_delta"]) == (50.0, 250.0, 250.0, 130.0)
    assert (r["temperature_min"], r["temperature_delta"], r["sbp_min"]) == (101.0, 0.0, None)
    assert (r["n_fever_readings"], r["n_tachycardia_readings"], r["n_bradycardia_readings"]) == (1, 2, 1)
    # one sinus and one fibrillation reading: the tie goes to the earlier one
    assert (r["rhythm_sinus"], r["rhythm_afib_flutter"], r["rhythm_irregular"]) == (1, 0, 1)
    snap = stays.withColumns({"heartrate": F.lit(88.0), "tachycardia": F.lit(0)})
    block = spark.createDataFrame([(1, 50.0, 250.0, 250.0, 130.0, 2, 1)], "stay_id bigint, heartrate_min double, heartrate_max double, "
                                  "heartrate_last double, heartrate_delta double, n_tachycardia_readings int, has_longitudinal_vitals int")
    filled = C.fill_longitudinal(snap.join(block, "stay_id", "left"), ["heartrate"], {"n_tachycardia_readings": "tachycardia"}).orderBy("stay_id").collect()
    assert (filled[1].heartrate_min, filled[1].heartrate_delta, filled[1].n_tachycardia_readings, filled[1].has_longitudinal_vitals) == (88.0, 0.0, 0, 0)
    assert filled[0].heartrate_max == 250.0


def test_trajectory_blob(spark):
    blobs = ['{"heartrate": [88, 105], "rhythm": ["sinus"]}', '{"sbp": 120, "dbp": null}', "none", "{}", "{broken", None, "[1]"]
    df = spark.createDataFrame(list(enumerate(blobs)), "i int, b string").select("i", P.parse_trajectory(F.col("b")).alias("t"))
    got = _values(df.select("i", "t.heartrate", "t.sbp", "t.dbp", "t.rhythm").withColumn("x", F.struct("heartrate", "sbp", "dbp", "rhythm")), "x")
    assert got[0].heartrate == [88.0, 105.0] and got[0].rhythm == ["sinus"] and got[1].sbp == [120.0]
    assert all(v is None for r in got[2:] for v in r) and got[1].dbp is None


def test_intake_parsers(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(P.parse_number(F.lit("about 98.6 F"))) == 98.6 and one(P.parse_number(F.lit(" Skip "))) is None
    assert tuple(one(P.parse_bp(F.lit("120 over 80")))) == (120.0, 80.0) and tuple(one(P.parse_bp(F.lit("118")))) == (118.0, None)
    assert one(P.parse_clock(F.lit("14:30"))) == 870.0 and one(P.parse_clock(F.lit("+15 min"))) == 15.0 and one(P.parse_clock(F.lit("now"))) is None
    fenced = "```json\n{\"narrative\": \" I fell \"}\n```"
    assert one(P.json_field_or_raw(F.lit(fenced), "narrative")) == "I fell" and one(P.json_field_or_raw(F.lit(" plain "), "narrative")) == "plain"


def test_order_rounds_needs_every_time(spark):
    rounds = F.array(F.struct(F.lit(9.0).alias("ts"), F.lit("a").alias("v")), F.struct(F.lit(2.0).alias("ts"), F.lit("b").alias("v")))
    untimed = F.array(F.struct(F.lit(9.0).alias("ts"), F.lit("a").alias("v")), F.struct(F.lit(None).cast("double").alias("ts"), F.lit("b").alias("v")))
    row = spark.range(1).select(P.order_rounds(rounds).alias("x"), P.order_rounds(untimed).alias("y")).first()
    assert [r.v for r in row.x] == ["b", "a"] and [r.v for r in row.y] == ["a", "b"]


def test_label_index_gathers_no_labels(spark):
    names = [f"label number {i * 7919 % 5000:06d}" for i in range(5000)]
    df = spark.createDataFrame([(x,) for x in [*names, names[3], None]], "x string")
    out = C.label_index(df, "x")
    assert sorted((r.label_idx, r.x) for r in out.distinct().collect()) == list(enumerate(sorted(names)))
    assert out.count() == 5001 and dict(out.dtypes)["label_idx"] == "int"
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_window_block_reads_the_readings_once(spark, tmp_path):
    t = datetime(2150, 1, 1)
    rows = [(1, t + timedelta(minutes=5 * i), 60.0 + i, "AF" if i % 2 else "NSR") for i in range(9)]
    spark.createDataFrame(rows, "stay_id bigint, charttime timestamp, heartrate double, rhythm string").write.parquet(f"{tmp_path}/readings")
    stays = spark.createDataFrame([(1, t + timedelta(minutes=10))], "stay_id bigint, intime timestamp")
    out = G.longitudinal_features(spark.read.parquet(f"{tmp_path}/readings"), stays, vitals=["heartrate"], abnormal={}, hours=0.25)
    assert f"{tmp_path}/readings" not in out._jdf.queryExecution().toString()
    (r,) = out.collect()
    assert (r.heartrate_min, r.heartrate_max, r.heartrate_last, r.rhythm_irregular, r.rhythm_sinus) == (62.0, 65.0, 65.0, 1, 1)
