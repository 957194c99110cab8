"""Report operators against published counts and small brute-force cases."""

import math

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.operators import comparison as K
from cohortloom.operators import metrics as M

# published acuity counts, true level by predicted level
ACUITY = [[2896, 1373, 497, 36, 1], [1646, 19750, 6205, 269, 12], [487, 9833, 30260, 4355, 77],
          [16, 80, 1906, 3515, 183], [4, 6, 33, 118, 59]]
LEVELS = [1, 2, 3, 4, 5]


def _acuity_counts(spark):
    rows = [(t, p, ACUITY[t - 1][p - 1]) for t in LEVELS for p in LEVELS]
    return spark.createDataFrame(rows, "true_label int, pred_label int, n bigint")


def test_published_confusion_gives_published_numbers(spark):
    conf = M.complete_confusion(_acuity_counts(spark), LEVELS)
    k = M.kappa(conf, LEVELS).first()
    assert (round(k.kappa_quadratic, 4), round(k.kappa_linear, 3), round(k.kappa, 3)) == (0.6449, 0.549, 0.473)
    rep = M.multiclass_report(M.per_class(conf)).first()
    assert (rep.n, round(rep.accuracy, 4), round(rep.balanced_accuracy, 3)) == (83617, 0.6755, 0.574)
    # every case once, by unrolling the counts
    rows = _acuity_counts(spark).select(F.col("true_label").alias("t"), F.col("pred_label").alias("p"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    o = M.ordinal_report(rows, "t", "p").first()
    assert (round(o.exact, 4), round(o.within_1, 4), round(o.within_2, 4), round(o.mae, 3)) == (0.6755, 0.9818, 0.9991, 0.344)
    assert (round(o.under_triage_rate, 4), round(o.over_triage_rate, 4)) == (0.1556, 0.1690)
    assert (round(o.critical_under_triage_overall, 4), round(o.critical_under_triage_among_critical, 4)) == (0.0840, 0.2148)


def test_published_threshold_counts(spark):
    df = spark.createDataFrame([(0.4, 44535, 8366, 5573, 25143), (0.5, 46709, 6192, 7221, 23495)], "threshold double, tn bigint, fp bigint, fn bigint, tp bigint")
    r = {x.threshold: x for x in M.binary_rates(df).collect()}
    assert abs(r[0.4].accuracy - 0.8332994486767045) < 1e-12 and abs(r[0.4].mcc - 0.6496802496565685) < 1e-12
    assert abs(r[0.4].f1_discharge - 0.8646817268394025) < 1e-12 and abs(r[0.5].under_triage - 0.23508920432347963) < 1e-12
    assert abs(r[0.5].predicted_admit_rate - 0.3550354592965545) < 1e-12


def test_published_calibration_bins(spark):
    gaps = [(27519, 5.667407563484175e-05), (11796, 0.003413405705833289), (6780, 0.014837139924015613), (4013, 0.005635365468737441),
            (3822, 0.0012845009144284991), (4477, 0.01062438489071671), (4423, 0.001201579103420336), (4211, 0.006099206581446359),
            (5227, 0.008028916083810733), (11349, 0.000563879907577558)]
    r = M.ece_mce(spark.createDataFrame(gaps, "n bigint, gap double")).first()
    assert (round(r.ece, 5), round(r.mce, 5)) == (0.00355, 0.01484)


def test_bin_edges(spark):
    df = spark.createDataFrame([(s,) for s in (0.0, 0.1, 0.3, 0.30000000000000004, 1.0)], "s double")
    assert [r.b for r in df.select(M.bin_of(F.col("s"), 10).alias("b")).collect()] == [0, 1, 2, 3, 9]


def _brute_auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def _brute_ap(pairs):
    total, out, tp, seen = sum(y for y, _ in pairs), 0.0, 0, 0
    for s in sorted({s for _, s in pairs}, reverse=True):
        here = [y for y, x in pairs if x == s]
        seen, tp = seen + len(here), tp + sum(here)
        out += sum(here) / total * tp / seen
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.1000001, 0.5, 0.9, 1.0, -3.0])), min_size=1, max_size=30))
def test_auc_and_ap_with_ties(spark, pairs):
    df = spark.createDataFrame(pairs, "y int, s double")
    r = M.ranking_metrics(df.withColumn("t", F.lit("a")), "y", "s", ["t"]).first()
    want = _brute_auc(pairs)
    if want is None:
        assert r.roc_auc is None and r.average_precision is None
    else:
        assert math.isclose(r.roc_auc, want, abs_tol=1e-12) and math.isclose(r.average_precision, _brute_ap(pairs), abs_tol=1e-12)
        flipped = M.roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first()
        assert math.isclose(r.roc_auc + flipped.roc_auc, 1.0, abs_tol=1e-12)


def test_ranks_and_losses(spark):
    df = spark.createDataFrame([(1, [0.2, 0.5, 0.3]), (2, [0.4, 0.4, 0.2]), (0, [0.4, 0.4, 0.2]), (5, [1.0, 0.0, 0.0])], "y int, p array<double>")
    assert [r.r for r in df.select(M.rank_of_true(F.col("y"), F.col("p")).alias("r")).collect()] == [1, 3, 1, None]
    r = M.topk_mrr(df, "y", "p", [1, 3]).first()
    assert (r.top1, r.top3) == (0.5, 0.75) and abs(r.mrr - (1 + 1 / 3 + 1 + 0) / 4) < 1e-12
    assert df.select(M.top_k_classes(F.col("p"), 2).alias("c")).first().c == [1, 2]
    assert abs(df.select(M.brier_multiclass(F.col("y"), F.col("p")).alias("b")).first().b - (0.04 + 0.25 + 0.09)) < 1e-12


def test_small_or_one_class_subgroup_carries_a_note(spark):
    df = spark.range(300).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 300).alias("m"), F.lit(0.5).alias("b"), "id")
    out = {r.subgroup: r for r in M.subgroup_report(df, "y", "b", "m", {"all": F.lit(True), "few": F.col("id") < 10, "ones": F.col("y") == 1}, 0.4).collect()}
    assert out["all"].note is None and out["few"].note and out["ones"].note and out["few"].model_acc is None
    assert abs(out["all"].base_auc - 0.5) < 1e-12


def test_missing_prediction_is_a_miss(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 4)], "t int, p int")
    r = M.accuracy_with_coverage(df, F.lit(True), F.col("p").isNotNull(), F.col("t") == F.col("p")).first()
    assert (r.n_eligible, r.n_produced) == (3, 2) and abs(r.accuracy_over_eligible - 1 / 3) < 1e-12 and r.accuracy_over_produced == 0.5


def test_gate_and_long_metrics(spark):
    rep = spark.range(1).select(F.struct(F.lit(0.5).alias("acc"), F.lit("x").alias("name"), F.array(F.lit(1), F.lit(2)).alias("bins")).alias("head"))
    assert {(r.metric, r.value) for r in K.to_long_metrics(rep).collect()} == {("head.acc", 0.5), ("head.bins[0]", 1.0), ("head.bins[1]", 2.0)}
    new = spark.createDataFrame([("a", 0.5), ("b", 0.6), ("d", 1.0)], "metric string, value double")
    ref = spark.createDataFrame([("a", 0.501), ("b", 0.5), ("c", 0.1)], "metric string, value double")
    gate = K.regression_gate(new, ref)
    assert {r.metric: r.status for r in gate.collect()} == {"a": "PASS", "b": "FAIL", "c": "NO_REF", "d": "NO_REF"}
    assert K.gate_status(gate).first().asDict() == {"n_checked": 2, "n_failed": 1, "status": "FAIL"}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture], phases=[Phase.generate])
@given(st.lists(st.tuples(*[st.integers(0, 4)] * 4), min_size=1, max_size=25))
def test_pareto_against_brute_force(spark, pts):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "trial int, a int, b int, c int, d int")
    better = lambda x, y, n: all(p >= q for p, q in zip(x[:n], y[:n])) and x[:n] != y[:n]
    for n, obj in ((2, {"a": "max", "b": "max"}), (3, {"a": "max", "b": "max", "c": "max"}),
                   (4, {"a": "max", "b": "max", "c": "max", "d": "max"})):
        want = {i for i, p in enumerate(pts) if not any(better(q, p, n) for q in pts)}
        assert {r.trial for r in K.pareto(df, obj).collect()} == want


def test_front_keeps_equal_rows_and_leaves_out_missing_values(spark):
    rows = [(1, 2.0, 1.0, -0.0), (2, 2.0, 1.0, 0.0), (3, 2.0, None, 9.0), (4, 1.0, 1.0, 0.0), (5, float("nan"), 9.0, 9.0), (6, 0.0, 3.0, -1.0)]
    df = spark.createDataFrame(rows, "trial int, a double, b double, c double")
    goals = {"a": "max", "b": "max", "c": "max"}
    assert {r.trial for r in K.pareto(df, goals).collect()} == {1, 2, 6}
    assert K.pareto(df.limit(0), goals).count() == 0
